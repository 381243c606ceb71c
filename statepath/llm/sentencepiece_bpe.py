"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Every pair of adjacent symbols that forms a piece enters an agenda ordered by score, then
by position; the best one merges, its new neighbours enter, and pairs whose symbols have
changed leave. Long words keep the agenda as a heap. Short ones, which are nearly all,
share arrays with a row for each word's agenda, of which each round takes the best entry.
What remains are pieces, and bytes for characters that the vocabulary lacks.

If no piece has a word mark after another character, merges never cross the start of a
word, so texts are cut there and the ids of frequent words are remembered. Within each
Arrow batch, what was not remembered is also encoded by the sentencepiece library, and a
difference is an error.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from statepath.llm.common import add_columns
from statepath.llm.token_counts import PairTable

MARK = "▁"
# Words whose ids a task remembers, and the longest that it remembers.
REMEMBERED = 200_000
REMEMBERED_LENGTH = 64
# Longest word whose agenda is a row of an array.
SHORT = 48
_NEVER = 1 << 30
_CHARACTER = 1 << 20
# Kinds of pieces in the model format.
_MERGED_KINDS = (1, 4, 5)  # normal, user-defined, unused
_USER_DEFINED = 4
_UNUSED = 5
_BYTE = 6
_BPE = 2


@dataclass
class Vocabulary:
    library: sentencepiece.SentencePieceProcessor
    ids: dict[str, int]
    cost: dict[str, float]  # minus the score
    agendas: Agendas
    byte_ids: list[int]
    end: int
    words: re.Pattern | None  # cuts a text where no merge can cross

    @staticmethod
    @functools.cache
    def load(path: str) -> Vocabulary:
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rules = model.normalizer_spec
        if model.trainer_spec.model_type != _BPE or not model.trainer_spec.byte_fallback:
            raise ValueError(f"not a merge-type vocabulary with byte fallback: {path}")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces:
            raise ValueError(f"only identity normalisation is supported: {path}")
        if not rules.add_dummy_prefix or not rules.escape_whitespaces:
            raise ValueError(f"only a leading word mark is supported: {path}")
        if model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"word marks at word ends are not supported: {path}")
        if any(p.type in (_USER_DEFINED, _UNUSED) for p in model.pieces):
            raise ValueError(f"user-defined or unused pieces are not supported: {path}")
        merged = [(i, p) for i, p in enumerate(model.pieces) if p.type in _MERGED_KINDS]
        library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        apart = all(MARK not in p.piece.lstrip(MARK) for _, p in merged)
        ids = {p.piece: i for i, p in merged}
        cost = {p.piece: -p.score for _, p in merged}
        return Vocabulary(
            library,
            ids,
            cost,
            Agendas(ids, cost),
            [i for i, p in enumerate(model.pieces) if p.type == _BYTE],
            library.eos_id(),
            re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if apart else None,
        )

    def cut(self, text: str) -> list[str]:
        """The words of a text, which are encoded one by one, with spaces as word marks."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return self.words.findall(marked) if self.words else [marked]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        merged = self.agendas.merge([words[i] for i in short])
        found: list = [None] * len(words)
        for i, symbols in zip(short, merged):
            found[i] = symbols
        ends = np.cumsum([len(x) for x in merged])
        lacking = np.flatnonzero(np.concatenate([*merged, np.zeros(0, np.int32)]) >= _CHARACTER)
        for i in np.unique(np.searchsorted(ends, lacking, side="right")):
            symbols = (chr(n - _CHARACTER) if n >= _CHARACTER else n for n in merged[i].tolist())
            found[short[i]] = self._spell(symbols)
        for i, word in enumerate(words):
            if found[i] is None:
                found[i] = self._spell(self.ids.get(x, x) for x in merge(word, self.cost))
        return found

    def _spell(self, symbols: Iterable[int | str]) -> np.ndarray:
        """Ids, with the bytes of characters that the vocabulary lacks."""
        found = []
        for own in symbols:
            found.extend((own,) if isinstance(own, int) else (self.byte_ids[b] for b in own.encode()))
        return np.array(found, np.int32)


def merge(word: str, cost: dict[str, float]) -> list[str]:
    """Merge the characters of ``word``, with the agenda as a heap."""
    symbols: list[str | None] = list(word)
    n = len(symbols)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    agenda = []
    for i in range(n - 1):
        pair = cost.get(symbols[i] + symbols[i + 1])
        if pair is not None:
            agenda.append((pair, i, i + 1, 2))
    heapq.heapify(agenda)
    while agenda:
        _, left, right, size = heapq.heappop(agenda)
        own, other = symbols[left], symbols[right]
        if own is None or other is None or len(own) + len(other) != size:
            continue  # one of the two has merged otherwise
        own += other
        symbols[left], symbols[right] = own, None
        following = after[left] = after[right]
        if following < n:
            before[following] = left
            pair = cost.get(own + symbols[following])
            if pair is not None:
                heapq.heappush(agenda, (pair, left, following, size + len(symbols[following])))
        previous = before[left]
        if previous >= 0:
            pair = cost.get(symbols[previous] + own)
            if pair is not None:
                heapq.heappush(agenda, (pair, previous, left, len(symbols[previous]) + size))
    return [s for s in symbols if s is not None]


class Agendas:
    """The agendas of many words at once: row by row the ranks of a word's adjacent pairs.

    In every round the best entry of each row merges. Numbers of symbols are ids; a
    character that is no piece has _CHARACTER plus its code point.
    """

    def __init__(self, ids: dict[str, int], cost: dict[str, float]):
        numbers = {c: _CHARACTER + ord(c) for piece in ids for c in piece} | ids
        ranks = {c: r for r, c in enumerate(sorted(set(cost.values())))}
        found = [
            (numbers[piece[:cut]], numbers[piece[cut:]], own, ranks[cost[piece]])
            for piece, own in ids.items()
            for cut in range(1, len(piece))
            if piece[:cut] in numbers and piece[cut:] in numbers
        ]
        left, right, formed, rank = (np.array(x, np.int64) for x in zip(*found))
        self._pairs = PairTable(left, right, formed)
        self._formed = formed.astype(np.int32)
        self._rank = np.append(rank, _NEVER).astype(np.int32)
        self._character = np.arange(_CHARACTER, _CHARACTER + 0x110000, dtype=np.int32)
        for piece, own in ids.items():
            if len(piece) == 1:
                self._character[ord(piece)] = own

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or the last place if there is none."""
        return np.minimum(self._pairs.ranks(left, right), len(self._formed))

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The numbers of the symbols that each word keeps; words have 1 to SHORT characters."""
        points = self._character[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        starts = np.cumsum(sizes) - sizes
        found: list = [None] * len(words)
        for low, high in zip((0, 6, 10, 16, 28), (6, 10, 16, 28, SHORT)):
            live = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(live):
                self._merge_rows(live, points, starts[live], sizes[live], high, found)
        return found

    def _merge_rows(self, live, points, starts, sizes, width: int, found: list) -> None:
        inside = np.arange(width) < sizes[:, None]
        symbols = np.where(inside, points[np.minimum(starts[:, None] + np.arange(width), len(points) - 1)], -1)
        filled = np.arange(width - 1) < sizes[:, None] - 1
        places = np.full(filled.shape, len(self._formed), np.int32)
        places[filled] = self._look_up(symbols[:, :-1][filled], symbols[:, 1:][filled])
        while len(live):
            ranks = self._rank[places]
            best = ranks.argmin(axis=1)  # of equal ranks the first
            rows = np.arange(len(live))
            done = ranks[rows, best] == _NEVER
            for row in np.flatnonzero(done):
                found[live[row]] = symbols[row, : sizes[row]]
            keep = ~done
            live, sizes, best = live[keep], sizes[keep] - 1, best[keep]
            symbols, places = symbols[keep], places[keep]
            rows = np.arange(len(live))
            symbols[rows, best] = self._formed[places[rows, best]]
            # what follows the merged pair moves up
            symbols[:, :-1] = np.where(np.arange(width - 1) > best[:, None], symbols[:, 1:], symbols[:, :-1])
            places[:, :-1] = np.where(np.arange(width - 2) >= best[:, None], places[:, 1:], places[:, :-1])
            places[:, -1] = len(self._formed)
            own = symbols[rows, best]
            after = np.flatnonzero(best < sizes - 1)
            places[after, best[after]] = self._look_up(own[after], symbols[after, best[after] + 1])
            before = np.flatnonzero(best > 0)
            places[before, best[before] - 1] = self._look_up(symbols[before, best[before] - 1], own[before])


_known: dict[str, dict[str, bytes]] = {}


def encode_batch(texts: list[str], path: str, end: bool = True, check: bool = True) -> list[np.ndarray]:
    """Ids of each text as 32-bit arrays."""
    vocabulary = Vocabulary.load(path)
    known = _known.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    cut = [vocabulary.cut(t) for t in texts]
    new = [w for w in set().union(*cut) if w not in known]
    fresh = vocabulary.encode_words(new)
    if check:
        # the library adds the leading mark itself; of an empty text it makes nothing
        own = [(w, ids) for w, ids in zip(new, fresh) if w != MARK]
        texts_of = [w[1:].replace(MARK, " ") for w, _ in own]
        for (word, ids), expected in zip(own, vocabulary.library.encode(texts_of, num_threads=1)):
            if ids.tolist() != expected:
                raise ValueError(f"{word!r} is encoded as {ids}, by the library as {expected}")
    known.update((w, ids.tobytes()) for w, ids in zip(new, fresh))
    last = np.array([vocabulary.end] if end else [], np.int32).tobytes()
    found = [
        np.frombuffer(b"".join(map(known.__getitem__, words)) + last, np.int32) for words in cut
    ]
    for word in new:
        if len(word) > REMEMBERED_LENGTH:
            del known[word]
    return found


def forget() -> None:
    _known.clear()


def encode(
    docs: DataFrame,
    path: str,
    text: str = "text",
    result: str = "ids",
    end: bool = True,
    check: bool = True,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with the ids of each text, an end id last if ``end``; null counts as empty.

    ``path`` names the vocabulary file, at the same place on every executor. A column with
    the result's name is replaced.
    """

    def run(piece: pa.RecordBatch) -> dict:
        texts = [t or "" for t in piece.column(text).to_pylist()]
        found = encode_batch(texts, path, end, check)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        return {result: pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))}

    without = () if keep_text else (text,)
    return add_columns(docs, run, {result: "array<int>"}, text, without, forget)


def decode(
    encoded: DataFrame, path: str, ids: str = "ids", result: str = "decoded", keep_ids: bool = True
) -> DataFrame:
    """``encoded`` with the text that the library decodes from ids; null ids give an empty text."""

    def run(piece: pa.RecordBatch) -> dict:
        library = Vocabulary.load(path).library
        column = piece.column(ids)
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        known = column.is_valid().to_numpy(zero_copy_only=False)
        texts = [
            library.decode(values[low:high].tolist()) if valid else ""
            for low, high, valid in zip(offsets[:-1], offsets[1:], known)
        ]
        return {result: pa.array(texts, pa.string())}

    return add_columns(encoded, run, {result: "string"}, ids, () if keep_ids else (ids,))


def round_trip(
    docs: DataFrame, path: str, text: str = "text", end: bool = True, keep_text: bool = True
) -> DataFrame:
    """``docs`` with ids, as encode gives them, and decoded, the library's text of these.

    One pass in one worker per task; encode and decode after each other take two. Null
    counts as empty. Columns with a result's name are replaced.
    """

    def run(piece: pa.RecordBatch) -> dict:
        found = encode_batch([t or "" for t in piece.column(text).to_pylist()], path, end)
        library = Vocabulary.load(path).library
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        values = np.concatenate(found) if found else np.zeros(0, np.int32)
        return {
            "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
            "decoded": pa.array([library.decode(x.tolist()) for x in found], pa.string()),
        }

    results = {"ids": "array<int>", "decoded": "string"}
    return add_columns(docs, run, results, text, () if keep_text else (text,), forget)
