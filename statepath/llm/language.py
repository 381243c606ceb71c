"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to ORDER bytes counts which byte followed.
A byte that followed its context c times, of n in all and d different ones, has
probability c / (n + d) there; any other byte pays the escape d / (n + d) and is predicted
by the next shorter context, without the bytes that the longer one had (full exclusion),
down to equal probabilities of all 256 bytes. A context that a language has not seen
costs nothing. The code length of a text is the sum over its bytes; the language with the
shortest is predicted.

The counts are frozen after learning, so the code length of every byte after every
context can be tabulated. Scoring then looks up the longest known context of each byte
and adds one table entry per language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import add_columns, bounded_sample, pieces, ship_code, utf8

ORDER = 3
# Different documents of a language that its statistics are learned from.
LEARN_DOCUMENTS = 1_000
# Full contexts counted less often, over all languages, are left out of the trees.
LEAST_CONTEXT = 4
UNDETERMINED = "und"
_START = ord("\n")  # stands before the first byte of a text
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte its context and itself as a number of ORDER + 1 bytes, the byte last."""
    grams = data.astype(np.uint32)
    starts = offsets[:-1]
    for back in range(1, ORDER + 1):
        earlier = np.full(len(data), _START, np.uint32)
        earlier[back:] = data[:-back] if len(data) > back else []
        for place in range(back):
            at = starts + place
            at = at[at < offsets[1:]]
            earlier[at] = _START
        grams |= earlier << np.uint32(8 * back)
    return grams


def count_grams(sample: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over the whole texts of a sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                langs = piece.column(lang).to_pylist()
                data, offsets = utf8(piece.column(text))
                grams = _grams(data, offsets)
                for own in sorted(set(langs)):
                    rows = [i for i, x in enumerate(langs) if x == own]
                    parts = [grams[offsets[i] : offsets[i + 1]] for i in rows]
                    found, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own] * len(found), pa.string()), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )

    counted = sample.select(lang, text).mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Tabulated code lengths: bits[language][state * symbols + symbol]."""

    languages: list[str]
    symbol: np.ndarray  # of each byte
    symbols: int
    state: np.ndarray  # longest known context, by the symbols of the ORDER bytes before
    bits: np.ndarray

    @staticmethod
    def build(languages: list[str], counted: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """From (grams, counts) of each language."""
        seen = np.zeros(256, bool)
        seen[_START] = True
        for grams, _ in counted:
            for back in range(ORDER + 1):
                seen[(grams >> (8 * back)) & 255] = True
        symbols = int(seen.sum()) + 1  # the last one stands for every unseen byte
        symbol = np.where(seen, np.cumsum(seen) - 1, symbols - 1)

        # contexts of each length as numbers in base ``symbols``
        packed = []
        for grams, counts in counted:
            code = np.zeros(len(grams), np.int64)
            for back in range(ORDER, -1, -1):
                code = code * symbols + symbol[(grams >> (8 * back)) & 255]
            packed.append((code, counts))
        everything = np.concatenate([c for c, _ in packed])
        weights = np.concatenate([n for _, n in packed])
        contexts = []
        for length in range(ORDER + 1):
            whole, inverse = np.unique(everything // symbols % symbols**length, return_inverse=True)
            if length == ORDER:
                whole = whole[np.bincount(inverse, weights) >= LEAST_CONTEXT]
            contexts.append(whole)
        first = np.concatenate([[0], np.cumsum([len(c) for c in contexts])])

        state = np.zeros(symbols**ORDER, np.int32)
        tails = np.arange(symbols**ORDER)
        for length in range(1, ORDER + 1):
            known = np.full(symbols**length, -1, np.int32)
            known[contexts[length]] = first[length] + np.arange(len(contexts[length]))
            own = known[tails % symbols**length]
            state[own >= 0] = own[own >= 0]

        multiplicity = np.ones(symbols)
        multiplicity[-1] = 256 - (symbols - 1)
        bits = np.empty((len(languages), first[-1] * symbols), np.float32)
        for own, (code, counts) in enumerate(packed):
            shorter = np.full((1, symbols), 1 / 256)  # order -1
            table = []
            for length in range(ORDER + 1):
                wanted = contexts[length]
                at = np.searchsorted(wanted, code // symbols % symbols**length)
                inside = at < len(wanted)
                inside[inside] = wanted[at[inside]] == (code // symbols % symbols**length)[inside]
                count = np.bincount(
                    at[inside] * symbols + code[inside] % symbols, counts[inside],
                    len(wanted) * symbols,
                ).reshape(len(wanted), symbols)
                if length:
                    parents = np.searchsorted(contexts[length - 1], wanted % symbols ** (length - 1))
                    below = shorter[parents]
                else:
                    below = shorter
                n = count.sum(axis=1, keepdims=True)
                followed = count > 0
                d = followed.sum(axis=1, keepdims=True)
                left = np.maximum((below * ~followed * multiplicity).sum(axis=1, keepdims=True), 1e-300)
                escaped = np.where(n > 0, d / np.maximum(n + d, 1) / left, 1.0) * below
                shorter = np.where(followed, count / np.maximum(n + d, 1), escaped)
                table.append(shorter)
            bits[own] = -np.log2(np.maximum(np.concatenate(table), 1e-30)).ravel()
        return Model(languages, symbol.astype(np.int32), symbols, state, bits)

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        totals = np.zeros((len(offsets) - 1, len(self.languages)))
        filled = np.flatnonzero(np.diff(offsets) > 0)
        if not len(filled):
            return totals
        grams = _grams(data, offsets)
        context = np.zeros(len(data), np.int64)
        for back in range(ORDER, 0, -1):
            context = context * self.symbols + self.symbol[(grams >> np.uint32(8 * back)) & 255]
        place = self.state[context].astype(np.int64) * self.symbols + self.symbol[data]
        for own in range(len(self.languages)):
            costs = self.bits[own][place].astype(np.float64)
            totals[filled, own] = np.add.reduceat(costs, offsets[filled])
        return totals


def sample_texts(usable: DataFrame, text: str, lang: str, limit: int) -> DataFrame:
    """At most ``limit`` different texts of each language; copies of a text count once.

    Texts are told apart by 128 bits of hashes, so only those of the sample are gathered,
    through partial aggregates.
    """
    hashes = ["_hash", "_other_hash"]
    hashed = usable.withColumn(hashes[0], F.xxhash64(text)).withColumn(
        hashes[1], F.xxhash64(F.lit("other"), text)
    )
    chosen = bounded_sample(hashed.select(lang, *hashes).distinct(), lang, limit, hashes[0])
    kept = hashed.join(F.broadcast(chosen), [lang, *hashes], "left_semi")
    return kept.groupBy(lang, *hashes).agg(F.first(text).alias(text)).select(lang, text)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int = LEARN_DOCUMENTS) -> Model:
    """Learn from at most ``limit`` texts of each language, chosen by a hash of the text.

    Copies of a text in a language count once. The sample bounds what the driver gathers: the counts of the byte sequences in it.
    """
    ship_code(docs.sparkSession)
    usable = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(lang, text)
    sample = sample_texts(usable, text, lang, limit)
    counted = count_grams(sample, text, lang).toArrow().sort_by([("lang", "ascending"), ("gram", "ascending")])
    names = np.array(counted.column("lang").to_pylist(), object)
    grams, n = counted.column("gram").to_numpy(), counted.column("n").to_numpy()
    languages = sorted(set(names))
    if not languages:
        return Model([], np.zeros(256, np.int32), 1, np.zeros(1, np.int32), np.zeros((0, 1), np.float32))
    return Model.build(languages, [(grams[names == x], n[names == x]) for x in languages])


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior of that language if all are as likely.

    A text that is null or has no letter is ``und`` with score 0, as is every text if
    nothing could be learned. Of equally short codes the first language by name wins.
    Columns with a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(piece: pa.RecordBatch) -> dict:
        model = shared.value
        content = piece.column(text)
        data, offsets = utf8(content)
        bits = model.code_lengths(data, offsets)
        letters = np.concatenate([[0], np.cumsum(_ASCII_LETTER[data])])
        plain = letters[offsets[1:]] > letters[offsets[:-1]]
        names, scores = [], []
        for i in range(piece.num_rows):
            known = plain[i] or bool(_LETTER.search(content[i].as_py() or ""))
            if not known or not model.languages:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            best = int(np.argmin(bits[i]))
            names.append(model.languages[best])
            scores.append(float(1 / np.exp2(np.maximum(bits[i][best] - bits[i], -1000)).sum()))
        return {"lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    results = {"lang_pred": "string", "score": "double"}
    return add_columns(docs, run, results, text, () if keep_text else (text,))
