"""Token counts of byte-level BPE vocabularies by rank-synchronous array merging.

Pre-tokens of many texts lie end to end in one array of symbols. In every round each
pre-token finds its lowest-ranked adjacent pair, and all occurrences of all those pairs
merge at once; a pre-token without a mergeable pair has its final number of symbols.
A pair can only form a symbol of higher rank than those of its parts, so merging all
occurrences of the lowest pair together equals merging them one by one.

Special strings in a text are one token each, as in the library's default, and nothing
is added at either end.
"""

from __future__ import annotations

import functools
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from statepath.llm.common import add_columns

# Fixed value: how byte-level BPE cuts a text before merging.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pre-tokens whose counts a task remembers, and the longest that it remembers.
REMEMBERED = 300_000
REMEMBERED_LENGTH = 64
# Bytes of pre-tokens that are merged at once.
MERGED_BYTES = 4 << 20
_NONE = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """Open-addressed hash table from a pair of symbols to its rank and merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self._shift = np.uint64(64 - bits)
        size = 1 << bits
        self._keys = np.full(size, np.iinfo(np.uint64).max, np.uint64)
        self._ranks = np.full(size, _NONE, np.int32)
        self._merged = np.zeros(size, np.int32)
        self._mask = size - 1
        keys = self._key(left, right)
        self._probes = 1
        for rank, (key, slot, symbol) in enumerate(zip(keys, self._slot(keys), merged)):
            probes = 1
            while self._ranks[slot] != _NONE:
                slot = (slot + 1) & self._mask
                probes += 1
            self._keys[slot], self._ranks[slot], self._merged[slot] = key, rank, symbol
            self._probes = max(self._probes, probes)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number above all ranks."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        found = np.where(self._keys[slots] == keys, self._ranks[slots], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (self._ranks[slots] != _NONE))
        for step in range(1, self._probes):
            if not len(open_):
                break
            at = (slots[open_] + step) & self._mask
            same = self._keys[at] == keys[open_]
            found[open_[same]] = self._ranks[at[same]]
            open_ = open_[~same & (self._ranks[at] != _NONE)]
        return found


@dataclass
class Vocabulary:
    """A byte-level BPE vocabulary: symbols of bytes, ranked pairs, special strings."""

    byte_symbols: np.ndarray
    pairs: PairTable
    merged: np.ndarray  # symbol by rank
    special: regex.Pattern | None
    pre_token: regex.Pattern

    @staticmethod
    @functools.cache
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel":
            raise ValueError(f"not a byte-level BPE vocabulary: {path}")
        if spec["normalizer"] or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError(f"normalisation or prefixes are not supported: {path}")
        vocab = spec["model"]["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        special = [t["content"] for t in spec["added_tokens"]]
        return Vocabulary(
            np.array([vocab[c] for c in byte_characters()], np.int32),
            PairTable(
                np.array([vocab[a] for a, _ in merges], np.int64),
                np.array([vocab[b] for _, b in merges], np.int64),
                merged,
            ),
            merged,
            regex.compile("|".join(map(regex.escape, special))) if special else None,
            regex.compile(PRE_TOKEN),
        )

    def count_symbols(self, pre_tokens: list[str]) -> np.ndarray:
        """Symbols that each pre-token keeps when all its merges are done."""
        encoded = [t.encode() for t in pre_tokens]
        counts = np.zeros(len(encoded), np.int64)
        sizes = np.array([len(t) for t in encoded], np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(encoded):
            before = ends[start] - sizes[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + MERGED_BYTES, side="right")))
            data = np.frombuffer(b"".join(encoded[start:stop]), np.uint8)
            counts[start:stop] = self._merge(self.byte_symbols[data], sizes[start:stop])
            start = stop
        return counts

    def _merge(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = sizes.copy()
        live = np.flatnonzero(sizes > 1)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        inside = sizes[owner] > 1
        symbols, sizes = symbols[inside], sizes[live]
        # ranks[i]: of the pair of symbols i and i + 1; none at the end of a pre-token
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        ranks = np.full(len(symbols), _NONE, np.int32)
        if len(symbols):
            ranks[:-1] = self.pairs.ranks(symbols[:-1], symbols[1:])
            ranks[starts + sizes - 1] = _NONE
        while len(live):
            lowest = np.minimum.reduceat(ranks, starts)
            done = lowest == _NONE
            if done.any():
                counts[live[done]] = sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, ranks = symbols[keep], ranks[keep]
                live, sizes, lowest = live[~done], sizes[~done], lowest[~done]
                if not len(live):
                    break
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            hit = np.flatnonzero(ranks == np.repeat(lowest, sizes))
            # of overlapping occurrences (a a a) every second one merges, from the left
            new_run = np.ones(len(hit), bool)
            new_run[1:] = np.diff(hit) > 1
            if not new_run.all():
                run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run_start) % 2 == 0]
            symbols[hit] = self.merged[ranks[hit]]
            gone = np.zeros(len(symbols), bool)
            gone[hit + 1] = True
            merged_in = np.add.reduceat(gone, starts, dtype=np.int64)
            # pairs that touch a merged symbol are ranked anew
            ranks[hit] = _NONE
            place = np.cumsum(~gone) - 1
            symbols, ranks = symbols[~gone], ranks[~gone]
            sizes = sizes - merged_in
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            last = starts + sizes - 1
            at = place[hit]
            touched = np.concatenate([at, at[at > 0] - 1])
            touched = touched[touched < len(symbols) - 1]
            ranks[touched] = self.pairs.ranks(symbols[touched], symbols[touched + 1])
            ranks[last] = _NONE
        return counts


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in printable}
    hidden = [b for b in range(256) if b not in shown]
    return [shown[b] if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


_counts: dict[str, dict[str, int]] = {}


def count_batch(texts: list[str], path: str) -> list[int]:
    """Token counts of texts, with the counts of frequent pre-tokens remembered."""
    vocabulary = Vocabulary.load(path)
    known = _counts.setdefault(path, {})
    if len(known) > REMEMBERED:
        known.clear()
    special_counts, split = [], []
    for text in texts:
        parts = vocabulary.special.split(text) if vocabulary.special else [text]
        special_counts.append(len(parts) - 1)
        found = vocabulary.pre_token.findall(parts[0])
        for part in parts[1:]:
            found.extend(vocabulary.pre_token.findall(part))
        split.append(found)
    new = [t for t in set().union(*split) if t not in known]
    known.update(zip(new, vocabulary.count_symbols(new).tolist()))
    totals = [sum(map(known.__getitem__, found)) + n for found, n in zip(split, special_counts)]
    for t in new:
        if len(t) > REMEMBERED_LENGTH:
            del known[t]
    return totals


def forget() -> None:
    _counts.clear()


def count_tokens(docs: DataFrame, path: str, text: str = "text", result: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text; null and empty texts have none.

    ``path`` names the vocabulary file, at the same place on every executor. A column with
    the result's name is replaced.
    """

    def count(piece: pa.RecordBatch) -> dict:
        texts = [t or "" for t in piece.column(text).to_pylist()]
        return {result: pa.array(count_batch(texts, path), pa.int64())}

    return add_columns(docs, count, {result: "long"}, text, finish=forget)
