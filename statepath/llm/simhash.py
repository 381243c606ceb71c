"""Near duplicates by SimHash, found through deletion-variant signatures.

Of two 64-bit fingerprints that differ in at most 3 bits, one half differs in at most one
bit. Each half is therefore indexed with each of its bits deleted in turn: such a pair
meets under one of these 64 keys, and is then verified. Only different fingerprints are
indexed, so copies cost nothing.

Fingerprints that meet under a key are linked in their task, which gives the edges of a
spanning forest, never all pairs of a group. A group of more than ``GROUP`` is cut again
by the same method: of the other half, 32 bits with at most 3 differences, one 16-bit
half differs in at most one bit, and of what then remains one byte does. With 8 bits left
and three deleted, no group at that depth has more than 2^11 fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import add_columns, attach_groups, free_name, let_go, mix, ship_code, utf8
from statepath.llm.components import components
from statepath.storage import Scratch, materialize

SHINGLE = 3
SEED = 42
GROUP = 2_048
# Linked nodes that a task holds before it writes their stars and starts anew.
TREE_NODES = 1 << 18
# Groups up to this size are compared pair by pair with array operations over the batch.
_SMALL = 6
_LAST_WIDTH = 16


@dataclass(frozen=True)
class Scheme:
    """Which segments (print, first bit, width) are indexed, and how many bits may differ."""

    prints: int
    segments: tuple[tuple[int, int, int], ...]
    distance: int
    # the segments are halves, so a group can be cut again by the other half
    halves: bool = False

    @property
    def columns(self) -> list[str]:
        return [f"print_{i}" for i in range(self.prints)]


CLOSE = Scheme(1, ((0, 0, 32), (0, 32, 32)), 3, halves=True)


def shingle_hashes(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 hashes of the word shingles of a text, repeats included.

    Words are split at ASCII white space, A-Z lower-cased; a text of fewer words than a
    shingle is one shingle, and a text without words has none.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), last.tolist())),
        np.uint64,
        n,
    )


def fingerprints(raw: bytes, shingle: int = SHINGLE, prints: int = 1) -> list[int]:
    """SimHashes of the word shingles of a text, repeats included.

    A text without words has fingerprint 0. The first one is of the shingle hashes,
    others of these scattered anew.
    """
    hashes = shingle_hashes(raw, shingle)
    n = len(hashes)
    if not n:
        return [0] * prints
    found = []
    for _ in range(prints):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        majority = 2 * bits.sum(axis=0, dtype=np.int64) > n
        found.append(int(np.packbits(majority, bitorder="little").view(np.uint64)[0]))
        hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return found


def node_of(prints: np.ndarray) -> np.ndarray:
    """One number for the fingerprints of each row: the fingerprint itself if it is one."""
    found = prints[:, 0]
    for i in range(1, prints.shape[1]):
        found = mix(found * np.uint64(0xD1B54A32D192ED03)) ^ prints[:, i]
    return found


def prints_of(texts: pa.Array, shingle: int = SHINGLE, prints: int = 1) -> np.ndarray:
    """The fingerprints of each text of a batch, a row each; a null counts as empty."""
    data, offsets = utf8(texts)
    raw = data.tobytes()
    known: dict[bytes, list[int]] = {}
    found = np.zeros((len(texts), prints), np.uint64)
    for i in range(len(texts)):
        own = raw[offsets[i] : offsets[i + 1]]
        if own not in known:
            known[own] = fingerprints(own, shingle, prints)
        found[i] = known[own]
    return found


def add_fingerprints(
    docs: DataFrame,
    text: str = "text",
    shingle: int = SHINGLE,
    scheme: Scheme = CLOSE,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with print_0, ... and node as (signed) longs; a null text counts as empty."""

    def compute(piece: pa.RecordBatch) -> dict:
        found = prints_of(piece.column(text), shingle, scheme.prints)
        columns = [*found.T, node_of(found)]
        return dict(zip(names, (pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns)))

    names = [*scheme.columns, "node"]
    return add_columns(docs, compute, dict.fromkeys(names, "long"), text, () if keep_text else (text,))


def _variants(key: np.ndarray, print_: np.ndarray, first, width: int, tag: int) -> list[np.ndarray]:
    """Keys of all one-bit deletions of ``width`` bits from bit ``first`` on."""
    own = (print_ >> np.asarray(first, np.uint64)) & np.uint64((1 << width) - 1)
    base = key * np.uint64(0x9E3779B97F4A7C15)
    found = []
    for bit in range(width):
        left = own & ~np.uint64(1 << bit)
        found.append(mix(base ^ left ^ np.uint64((tag * 64 + bit + 1) << 40)))
    return found


def _explode(rows: DataFrame, scheme: Scheme, width: int) -> DataFrame:
    """The rows once under each key: of the scheme's segments, or of halves of what is left."""
    names = ["key", *scheme.columns, "rest"]

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                key, *prints, rest = (part.column(c).to_numpy().view(np.uint64) for c in names)
                keys, others = [], []
                if width == 64:
                    for tag, (number, first, size) in enumerate(scheme.segments):
                        own = _variants(key, prints[number], first, size, tag)
                        keys += own
                        rest_of = 32 - first if scheme.halves else 0
                        others += [np.full(len(key), rest_of, np.uint64)] * len(own)
                else:
                    half = width // 2
                    for side in (0, 1):
                        own = _variants(key, prints[0], rest + np.uint64(side * half), half, side)
                        keys += own
                        others += [rest + np.uint64((1 - side) * half)] * half
                columns = [np.concatenate(keys), *(np.tile(p, len(keys)) for p in prints), np.concatenate(others)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.view(np.int64)) for x in columns], names=names
                )
        let_go()

    return rows.mapInArrow(explode, ", ".join(f"{c} long" for c in names))


def _differing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.bitwise_count(left ^ right).sum(axis=1, dtype=np.int64)


def _forest(prints: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Places of edges that connect what links of at most ``distance`` bits connect."""
    todo = np.arange(len(prints))
    frontier: list[int] = []
    left, right = [], []
    while len(todo) or frontier:
        if not frontier:
            frontier, todo = [int(todo[0])], todo[1:]
        own = frontier.pop()
        near = _differing(prints[todo], prints[own]) <= distance
        reached = todo[near].tolist()
        left += [own] * len(reached)
        right += reached
        frontier += reached
        todo = todo[~near]
    return left, right


class _Trees:
    """Union-find over the linked nodes of a task, so that it reports stars only."""

    def __init__(self):
        self._above: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self._above)

    def find(self, node: int) -> int:
        path = []
        while (above := self._above.setdefault(node, node)) != node:
            path.append(node)
            node = above
        for passed in path:
            self._above[passed] = node
        return node

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self._above[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(n, root) for n in list(self._above) if (root := self.find(n)) != n]


def _links(
    keyed: DataFrame, scheme: Scheme, group_limit: int | None, tree_nodes: int = TREE_NODES
) -> DataFrame:
    """Edges (a, b) between nodes, and the rows of groups beyond the limit (overfull).

    Rows must lie together by key. They stream through the task; only the group at hand,
    up to the limit, and links of about ``tree_nodes`` nodes are held: a node may be in
    several stars, which the components connect.
    """
    names = ["key", *scheme.columns, "rest"]
    schema = "overfull boolean, a long, b long, " + ", ".join(f"{c} long" for c in names)
    kinds = [pa.bool_()] + [pa.int64()] * (len(names) + 2)

    def out(overfull: bool, columns: list) -> pa.RecordBatch:
        n = len(columns[0])
        own = [pa.array(np.asarray(x, np.uint64).view(np.int64)) for x in columns]
        none = [pa.nulls(n, pa.int64())]
        flags = pa.array(np.full(n, overfull))
        arrays = [flags, *none * 2, *own] if overfull else [flags, *own, *none * len(names)]
        return pa.RecordBatch.from_arrays(
            [a.cast(k) for a, k in zip(arrays, kinds)], names=["overfull", "a", "b", *names]
        )

    def stars(trees: _Trees) -> list[np.ndarray]:
        return list(np.array(trees.stars(), np.uint64).reshape(-1, 2).T)

    def close(trees: _Trees, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Complete groups, in key order."""
        key, prints = columns[0], np.stack(columns[1:-1], axis=1)
        nodes = node_of(prints)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        sizes = np.diff(cuts)
        group = np.repeat(np.arange(len(sizes)), sizes)
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= _SMALL), sizes))
        for lag in range(1, _SMALL):
            left, right = small[:-lag], small[lag:]
            near = group[left] == group[right]
            left, right = left[near], right[near]
            near = _differing(prints[left], prints[right]) <= scheme.distance
            trees.add(nodes[left[near]], nodes[right[near]])
        for i in np.flatnonzero(sizes > _SMALL):
            at = slice(cuts[i], cuts[i + 1])
            if group_limit is not None and sizes[i] > group_limit:
                yield out(True, [x[at] for x in columns])
            else:
                left, right = _forest(prints[at], scheme.distance)
                trees.add(nodes[at][left], nodes[at][right])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _Trees()
        held = [np.zeros(0, np.uint64)] * len(names)
        passing = None  # the key of an overfull group whose start has been passed on
        for batch in batches:
            new = [batch.column(c).to_numpy().view(np.uint64) for c in names]
            columns = [np.concatenate(x) for x in zip(held, new)]
            if passing is not None:
                other = np.flatnonzero(columns[0] != passing)
                stop = int(other[0]) if len(other) else len(columns[0])
                yield out(True, [x[:stop] for x in columns])
                held = columns = [x[stop:] for x in columns]
                if not len(other):
                    continue
                passing = None
            changes = np.flatnonzero(np.diff(columns[0]))
            last = int(changes[-1]) + 1 if len(changes) else 0
            if last:
                yield from close(trees, [x[:last] for x in columns])
            if len(trees) >= tree_nodes:
                yield out(False, stars(trees))
                trees = _Trees()
            held = [x[last:] for x in columns]
            if group_limit is not None and len(held[0]) > group_limit:
                passing = held[0][0]
                yield out(True, held)
                held = [x[:0] for x in held]
        if len(held[0]):
            yield from close(trees, held)
        yield out(False, stars(trees))
        del trees, held
        let_go()

    return keyed.mapInArrow(run, schema)


def find_links(
    prints: DataFrame,
    scheme: Scheme = CLOSE,
    group_limit: int = GROUP,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Edges (a, b) between nodes that connect all links of the scheme, and nothing else.

    ``prints`` has one row for each node. An edge may stand for a chain of links.
    """
    ship_code(prints.sparkSession)
    zero = F.lit(0).cast("long")
    rows = prints.select(zero.alias("key"), *scheme.columns, zero.alias("rest"))
    edges = None
    width = 64
    while True:
        keyed = _explode(rows, scheme, width).repartition("key").sortWithinPartitions("key")
        can_cut = scheme.halves and width > _LAST_WIDTH
        found = keep(_links(keyed, scheme, group_limit if can_cut else None))
        own = found.where("not overfull").select("a", "b")
        edges = own if edges is None else edges.union(own)
        rows = found.where("overfull").select("key", *scheme.columns, "rest")
        if not can_cut or rows.isEmpty():
            return edges
        width //= 2


def near_groups(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    scheme: Scheme = CLOSE,
    group_limit: int = GROUP,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with its fingerprints and component_id: the least id that links can reach.

    A component without any id has a null component_id. Columns with a result's name are
    replaced, others stay, whatever their names. The rows, without the text if it is not
    kept, are written once with their fingerprints.
    """
    taken = [*docs.columns, *scheme.columns]
    size = free_name("n_rows", taken)
    with Scratch(docs.sparkSession) as scratch:
        # what is returned is read from these two, so they stay
        printed = materialize(add_fingerprints(docs, text, shingle, scheme, keep_text))
        own = scratch.keep(
            printed.groupBy("node", *scheme.columns).agg(
                F.min(row_id).alias("least_id"), F.count(F.lit(1)).alias("n_rows")
            )
        )
        roots = scratch.keep(components(find_links(own, scheme, group_limit, scratch.keep), "a", "b"))
        linked = scratch.keep(roots.join(own, "node").select("node", "root", "least_id"))
        named = name_components(linked, scratch)
        groups = materialize(
            own.join(named, "node", "left").select(
                "node", F.col("n_rows").alias(size), F.coalesce("component_id", "least_id").alias("component_id")
            )
        )
    sizes = groups.select("node", size)
    grouped = attach_groups(printed, groups, "node", size, F.col(row_id), sizes=sizes)
    return grouped.drop(size)


def name_components(linked: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component_id) from written (node, root, least_id): the least id of a root's nodes."""
    least = linked.groupBy("root").agg(
        F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")
    )
    named = attach_groups(linked, least, "root", "n", F.col("node"), keep=scratch.keep)
    return named.select("node", "component_id")
