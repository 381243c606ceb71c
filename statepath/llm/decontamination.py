"""Benchmark decontamination.

Test items are cut into windows of consecutive words. Their hashes form a sorted array
that is broadcast; every task hashes the windows of its training texts with running
sums, compares the words of each hit with the item's own, and marks the words a window
covers. Texts never leave their task, so there is no shuffle.

Words are runs of digits, letters and all characters beyond ASCII, with A-Z lower-cased.
An item with fewer words than a window, but not none, is one window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import (
    Powers,
    SpanHash,
    add_columns,
    free_name,
    mix,
    text_blocks,
    utf8,
    words_of,
)
from statepath.storage import materialize

WINDOW = 13
# Item text that is broadcast at once: its index takes about ten times as much memory.
BLOCK_BYTES = 4 << 20

_BYTES = np.arange(256)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = (
    ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))
    | ((_LOWER >= ord("a")) & (_LOWER <= ord("z")))
    | (_BYTES >= 0x80)
)
_VALUES = mix(_LOWER.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_BYTE_POWERS = Powers(0x5851F42D4C957F2D)
_WORD_POWERS = Powers(0x14057B7EF767814F)
SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class _Words:
    """The words of a batch of texts and hashes of their windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.text = words_of(data, offsets, _IS_WORD)
        self._bytes = _LOWER[data].tobytes()
        words = SpanHash(_VALUES[data], _BYTE_POWERS)(self.starts, self.ends)
        self._windows = SpanHash(words, _WORD_POWERS)

    def windows(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all windows of ``length`` words within one text."""
        places = np.arange(max(0, len(self.starts) - length + 1))
        places = places[self.text[places] == self.text[places + length - 1]]
        return places, self._windows(places, places + length)

    def at(self, place: int, length: int) -> list[bytes]:
        spans = zip(self.starts[place : place + length], self.ends[place : place + length])
        return [self._bytes[s:e] for s, e in spans]


@dataclass
class WindowIndex:
    """All windows of a block of items: for each length, sorted hashes and their places."""

    ids: list
    words: list[list[bytes]]
    lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def build(items: list[tuple], window: int) -> WindowIndex:
        found: dict[int, list[tuple]] = {}
        ids, listed = [], []
        for item_id, text in items:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            words = _Words(raw, np.array([0, len(raw)]))
            n = len(words.starts)
            if not n:
                continue
            length = min(window, n)
            places, hashes = words.windows(length)
            found.setdefault(length, []).append((hashes, np.full(len(places), len(ids)), places))
            ids.append(item_id)
            listed.append(words.at(0, n))
        lengths = {}
        for length, parts in found.items():
            hashes, item, place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            lengths[length] = hashes[order], item[order], place[order]
        return WindowIndex(ids, listed, lengths)

    def search(self, words: _Words) -> Iterator[tuple[int, int, int]]:
        """(place, length, item) of every verified window in a batch of texts."""
        for length, (known, item, place) in self.lengths.items():
            maybe = np.zeros(1 << 16, bool)
            maybe[known >> np.uint64(48)] = True
            places, hashes = words.windows(length)
            near = maybe[hashes >> np.uint64(48)]
            places, hashes = places[near], hashes[near]
            first = np.searchsorted(known, hashes, side="left")
            last = np.searchsorted(known, hashes, side="right")
            for i in np.flatnonzero(first < last):
                own = words.at(places[i], length)
                for j in range(first[i], last[i]):
                    p = place[j]
                    if self.words[item[j]][p : p + length] == own:
                        yield int(places[i]), length, int(item[j])


def scan(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as strings, sorted) and spans to remove.

    Spans are character offsets of runs of hit words. A null text has no words. Items
    beyond one block are searched block by block, each over all texts, so that no
    broadcast exceeds the bound; a repeated item counts each of its ids. An item without
    an id marks words but is not listed. Columns of ``docs`` with a result's name are
    replaced.
    """
    spark = docs.sparkSession
    working = free_name("_marks", docs.columns)
    found = docs.withColumn(working, F.lit(None).cast("array<long>")).withColumn(
        "items", F.array().cast("array<string>")
    )
    results = {"n_words": "long", "n_hit": "long", "spans": SPANS, "items": "array<string>"}
    found_any = False
    for block in text_blocks(items, item_id, item_text, block_bytes):
        if found_any:  # a block's scan is written before the next one's begins
            found = materialize(found)
        shared = spark.sparkContext.broadcast(WindowIndex.build(block, window))

        def mark(piece: pa.RecordBatch, shared=shared) -> dict:
            return _mark(piece, text, shared.value, working)

        found = add_columns(
            found, mark, results | {working: "array<long>"}, text, without=("items", working)
        )
        found_any = True
    return found.drop(working)


def _mark(piece: pa.RecordBatch, text: str, index: WindowIndex, working: str) -> dict:
    data, offsets = utf8(piece.column(text))
    words = _Words(data, offsets)
    n = piece.num_rows
    n_words = np.bincount(words.text, minlength=n)
    first_word = np.concatenate([[0], np.cumsum(n_words)])
    cover = np.zeros(len(words.starts) + 1, np.int32)
    items: dict[int, set] = {}
    for place, length, item in index.search(words):
        cover[place] += 1
        cover[place + length] -= 1
        if index.ids[item] is not None:
            items.setdefault(int(words.text[place]), set()).add(str(index.ids[item]))
    hit = np.cumsum(cover[:-1]) > 0
    earlier_marks = piece.column(working)
    earlier_items = piece.column("items")
    if earlier_marks.null_count < n:
        for i, marks in enumerate(earlier_marks.to_pylist()):
            hit[first_word[i] + np.array(marks or [], np.int64)] = True
            items.setdefault(i, set()).update(earlier_items[i].as_py() or [])
    n_hit = np.bincount(words.text[hit], minlength=n)
    spans, marks, listed = [], [], []
    for i in range(n):
        listed.append(sorted(items.get(i, ())))
        if not n_hit[i]:
            spans.append([])
            marks.append([])
            continue
        own = np.flatnonzero(hit[first_word[i] : first_word[i + 1]])
        marks.append(own.tolist())
        spans.append(_spans(own, words, first_word[i], data[offsets[i] : offsets[i + 1]], offsets[i]))
    return {
        "n_words": pa.array(n_words, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "spans": pa.array(spans, _SPAN_TYPE),
        "items": pa.array(listed, pa.list_(pa.string())),
        working: pa.array(marks, pa.list_(pa.int64())),
    }


def _spans(own: np.ndarray, words: _Words, first: int, raw: np.ndarray, base: int) -> list[dict]:
    """Character offsets of the runs of hit words in one text."""
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(own) > 1)
    heads = own[np.concatenate([[0], breaks + 1])]
    tails = own[np.concatenate([breaks, [len(own) - 1]])]
    starts = characters[words.starts[first + heads] - base]
    ends = characters[words.ends[first + tails] - base]
    return [{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)]


def contaminated(one_in: int = 20) -> Column:
    """True for a scanned row with a hit word and at least one hit in ``one_in`` words."""
    return (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words"))


def remove_documents(scanned: DataFrame, one_in: int = 20) -> DataFrame:
    """The rows that are not contaminated."""
    return scanned.where(~contaminated(one_in))


def remove_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the runs of hit words cut out of the text."""
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"])).alias("start"),
        F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text))).alias("end"),
    )
    kept = F.transform(gaps, lambda g: F.substring(F.col(text), g["start"] + 1, g["end"] - g["start"]))
    return scanned.withColumn(
        text, F.when(F.size("spans") > 0, F.array_join(kept, "")).otherwise(F.col(text))
    )
