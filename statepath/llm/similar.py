"""Near duplicates by SimHash, with an exact check of the word shingles.

Texts are fingerprinted and fingerprints of at most three differing bits are found by
``simhash``; such texts are candidates. Two texts are linked if their sets of five-word
shingles have a Jaccard similarity of at least 4/5, which each candidate is tested for on
the whole sets before it becomes an edge. Edited texts often differ in more bits than
that and still have this similarity. For them there is an exact way besides, prefix
filtering: put the shingles of all texts in one order; two linked texts of n and at most
n shingles share one among the first n - ceil(4n/5) + 1 of each, whatever the order. So no
linked pair is missed.
The order puts shingles that many texts share last, which keeps the groups under a key
small; how often they occur is estimated on a sample, as any order gives the same links.

Equal texts are one node, known by their MD5. Keys under which a node is alone are dropped
by the first join. Every node is first compared with the least node that fingerprints
reach and, under each key, with one hub, the same for many keys. What that links is
contracted, the hubs' part ``ROUNDS`` times with other hubs:
of a large group of near copies little is left then. Nodes of a key that are in different
components are compared in pairs, dealt into cells of at most about ``CELL`` by ``CELL``
nodes, so that no task holds more. Before sets are compared, pairs go through two bounds
that no linked pair fails: on the sizes, and on the differing bits of parity sketches.

Apart from the sample, texts are shingled once for their keys and once more, if a pair of
theirs passes the bounds, for the sets to compare, which are kept until the links are known. Tables are
deleted as soon as they have been used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import add_columns, attach_few_groups, attach_groups, free_name, mix, set_aside, utf8
from statepath.llm.components import components
from statepath.llm.simhash import CLOSE, find_links, name_components, prints_of, shingle_hashes
from statepath.storage import Scratch, materialize

SHINGLE = 5
CELL = 1_024
ROUNDS = 2
# Texts whose shingles are counted for the order, and how many frequent ones it knows.
_COUNTED_TEXTS = 10_000
_FREQUENT = 5
_MOST_FREQUENT = 1 << 18
# The key of texts without words.
_NO_WORDS = np.zeros(1, np.uint64)


# Bits of the shortest sketch.
_BITS = 512


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of how many shingles fall on each bit; at least as many bits as shingles.

    The bits are a power of two; the halves of a sketch, xored, are that of half the bits.
    """
    bits = _BITS
    while bits < len(shingles):
        bits *= 2
    places = (shingles & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(places, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _sets_of(piece: pa.RecordBatch, shingle: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text."""
    data, offsets = utf8(piece.column("content"))
    raw = data.tobytes()
    return [
        np.unique(shingle_hashes(raw[offsets[i] : offsets[i + 1]], shingle))
        for i in range(piece.num_rows)
    ]


def _listed(sets: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, sets)])
    joined = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(joined))


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``texts`` with the shingles in place of the content."""

    def compute(piece: pa.RecordBatch) -> dict:
        return {"shingles": _listed(_sets_of(piece, shingle))}

    return add_columns(texts, compute, {"shingles": "array<long>"}, "content", ("content",))


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that a bounded sample of the texts has often, and how often."""
    total = texts.count()
    drawn = F.pmod(F.xxhash64("digest", F.lit("order")), F.lit(1 << 30))
    sample = texts.where(drawn < _COUNTED_TEXTS / max(1, total) * (1 << 30)).select("content")
    frequent = (
        _sets(sample, shingle)
        .select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= _FREQUENT)
        .orderBy(F.desc("n"), "shingle")
        .limit(_MOST_FREQUENT)
        .toArrow()
    )
    names = frequent.column("shingle").to_numpy().astype(np.int64)
    by_name = np.argsort(names)
    return names[by_name], frequent.column("n").to_numpy()[by_name]


def read_texts(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``texts`` (content, digest) with print_0, size, sketch and the keys of each set.

    One Python pass: a second one in the same stage would keep another worker for each core.
    """
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))

    def keys_of(own: np.ndarray) -> np.ndarray:
        """The first shingles of a set: the least frequent ones, by their hash among equals."""
        names, counts = shared.value
        n = len(own)
        if not n:
            return _NO_WORDS
        places = np.searchsorted(names, own.view(np.int64))
        known = places < len(names)
        known[known] = names[places[known]] == own.view(np.int64)[known]
        often = np.zeros(n, np.int64)
        often[known] = counts[places[known]]
        return own[np.lexsort((mix(own), often))[: n - (4 * n + 4) // 5 + 1]]

    def compute(piece: pa.RecordBatch) -> dict:
        prints = prints_of(piece.column("content"), prints=CLOSE.prints)
        sets = _sets_of(piece, shingle)
        return {
            **{c: pa.array(p.view(np.int64)) for c, p in zip(CLOSE.columns, np.ascontiguousarray(prints.T))},
            "size": pa.array([len(s) for s in sets], pa.int64()),
            "keys": _listed([keys_of(s) for s in sets]),
            "bits": _listed([sketch(s) for s in sets]),
        }

    results = dict.fromkeys(CLOSE.columns, "long") | {
        "size": "long", "keys": "array<long>", "bits": "array<long>"
    }
    return add_columns(texts, compute, results, "content", ("content",))


class _Search:
    """The search for links between the nodes of one table of texts."""

    def __init__(self, texts: DataFrame, shingle: int, cell: int, scratch: Scratch):
        """``texts`` has id, content and digest."""
        self.shingle, self.cell, self.scratch = shingle, cell, scratch
        self.keep: Callable[[DataFrame], DataFrame] = scratch.keep
        self.texts = texts
        number = F.monotonically_increasing_id().alias("node")
        self.read = self.keep(read_texts(texts, shingle).select("*", number))
        self.nodes = self.keep(
            self.read.groupBy("digest").agg(
                F.min("node").alias("node"), F.min("id").alias("least_id"),
                F.count(F.lit(1)).alias("n_rows"), F.first("size").alias("size"), F.first("bits").alias("bits"),
                F.first("print_0").alias("print_0"),
            )
        )
        self.repeats = not self.nodes.where("n_rows > 1").isEmpty()
        self.sets: DataFrame | None = None

    def close_pairs(self) -> DataFrame:
        """Pairs (a, b): each node that fingerprints link to others, and the least of these."""
        own = self.keep(
            self.nodes.groupBy("print_0").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
        )
        reached = components(find_links(own, keep=self.keep), "a", "b").withColumnRenamed("node", "print_0")
        rooted = self.keep(
            own.join(reached, "print_0", "left").withColumn("print_root", F.coalesce("root", "print_0"))
        )
        hubs = self.keep(
            rooted.groupBy("print_root").agg(
                F.min("least").alias("hub"), F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_prints")
            )
        )
        several = self.keep(hubs.where("n_nodes > 1"))
        named = attach_groups(
            rooted.select("print_root", "print_0", "n"), several, "print_root", "n_prints",
            F.col("print_0"), "inner", several.select("print_root", "n_prints"),
        )
        groups = self.keep(named.select("print_0", "n", "hub"))
        nodes = self.nodes.select("print_0", "node")
        joined = attach_groups(nodes, groups, "print_0", "n", F.col("node"), "inner", groups.select("print_0", "n"))
        pairs = self.keep(joined.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        self.scratch.drop(own, rooted, hubs, several, groups)
        return pairs

    def index(self) -> DataFrame:
        """(key, node, n, hub): each node under its keys, where it is not alone."""
        read = self.read
        if self.repeats:
            read = read.join(self.nodes.select("node"), "node", "left_semi")
        rows = read.select(F.explode("keys").alias("key"), "node")
        groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub"))
        live = self._under_keys(rows, groups.where("n > 1"))
        self.scratch.drop(self.read)
        return live

    def _under_keys(self, rows: DataFrame, groups: DataFrame) -> DataFrame:
        groups = self.keep(groups)
        sizes = groups.select("key", "n")
        live = self.keep(attach_groups(rows, groups, "key", "n", F.col("node"), "inner", sizes))
        self.scratch.drop(groups)
        return live

    def fetch_sets(self, pairs: DataFrame) -> DataFrame:
        """(node, shingles) of all nodes of the pairs, read now unless they have been before."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        if self.sets is not None:
            ends = ends.join(self.sets.select("node"), "node", "left_anti")
        wanted = self.keep(self.nodes.join(ends, "node", "left_semi").select("digest", "node", "n_rows"))
        rows = self.texts.select("content", "digest", "id")
        named = attach_few_groups(rows, wanted, "digest", "n_rows", F.col("id"), "inner")
        sets = _sets(named.select("node", "content"), self.shingle)
        if self.repeats:
            sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets = self.keep(sets)
        self.sets = sets if self.sets is None else self.sets.union(sets)
        return self.sets

    def _attach(self, pairs: DataFrame, table: DataFrame, end: str, columns: dict[str, Column]) -> DataFrame:
        """Columns of the node at one end of the pairs; a node may be at the end of many."""
        sizes = self.keep(pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n")))
        other = "b" if end == "a" else "a"
        groups = table.select(F.col("node").alias(end), *[c.alias(n) for n, c in columns.items()])
        # sets and sketches are wide: never through the driver, also where they are few
        groups = groups.hint("shuffle_merge")
        joined = attach_groups(pairs, groups, end, "n", F.col(other), "inner", sizes)
        self.scratch.drop(sizes)
        return joined

    def linked(self, pairs: DataFrame, info: DataFrame) -> DataFrame:
        """Of written pairs (a, b) of nodes in different components those that are similar."""
        near = pairs
        for end in ("a", "b"):
            values = {f"{c}_{end}": F.col(c) for c in ("root", "size", "bits")}
            near = self._attach(near, info, end, values)
        near = self.keep(
            near.where((F.col("root_a") != F.col("root_b")) & _may_link("size_a", "size_b", "bits_a", "bits_b"))
            .select("a", "b").distinct()
        )
        sets, full = self.fetch_sets(near), near
        for end in ("a", "b"):
            full = self._attach(full, sets, end, {f"set_{end}": F.col("shingles")})
        shared = F.size(F.array_intersect("set_a", "set_b"))
        # shared / (total - shared) >= 4 / 5
        similar = 9 * shared >= 4 * (F.size("set_a") + F.size("set_b"))
        found = self.keep(full.where(similar).select("a", "b"))
        self.scratch.drop(near)
        return found

    def with_roots(self, roots: DataFrame | None) -> DataFrame:
        """The nodes with their root: themselves until an edge links them."""
        info = self.nodes.select("node", "size", "bits")
        if roots is None:
            return info.withColumn("root", F.col("node"))
        return self.keep(
            info.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        )

    def live_under(self, rows: DataFrame, info: DataFrame) -> DataFrame:
        """(key, node, root, n, hub) under keys with several components."""
        # a node has no more keys than a fifth of its shingles, so none is hot
        rooted = self.keep(rows.select("key", "node").join(info.select("node", "root"), "node"))
        groups = rooted.groupBy("key").agg(
            F.count(F.lit(1)).alias("n"), F.max("node").alias("hub"),
            F.min("root").alias("low"), F.max("root").alias("high"),
        )
        live = self._under_keys(rooted, groups.where("low < high").drop("low", "high"))
        self.scratch.drop(rooted)
        return live

    def other_pairs(self, live: DataFrame, info: DataFrame) -> DataFrame:
        """Pairs under a key that are in different components and within the bounds.

        One of the two is outside the key's largest component: those are the right side.
        """
        roots = live.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        groups = (
            roots.groupBy("key")
            .agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("main"))
            .select("key", "n", F.col("main.root").alias("main"), (F.col("n") - F.col("main.n")).alias("n_others"))
        )
        rows = self._under_keys(live.select("key", "node", "root"), groups)
        rows = self.keep(rows.join(info.drop("root"), "node"))
        deals = {
            "i": (F.ceil(F.col("n") / self.cell), F.lit(1)),
            "j": (F.ceil(F.col("n_others") / self.cell), F.lit(2)),
        }

        def dealt(rows: DataFrame, own: str) -> DataFrame:
            other = "j" if own == "i" else "i"
            blocks, salt = deals[own]
            every = F.sequence(F.lit(0).cast("long"), deals[other][0] - 1)
            return rows.withColumn(own, F.pmod(F.xxhash64("node", salt), blocks)).withColumn(
                other, F.explode(every)
            )

        left = dealt(rows, "i").alias("l")
        right = dealt(rows.where("root <> main"), "j").alias("r")
        met = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
        once = (F.col("l.root") == F.col("l.main")) | (F.col("l.node") < F.col("r.node"))
        bounds = _may_link("l.size", "r.size", "l.bits", "r.bits")
        pairs = left.join(
            right, met[0] & met[1] & met[2] & (F.col("l.root") != F.col("r.root")) & once & bounds
        )
        return self.keep(pairs.select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct())

    def roots(self, rounds: int) -> DataFrame:
        """(node, root) of every node that a link reaches."""
        live, close = self.index(), self.close_pairs()
        info, roots = self.with_roots(None), None
        for turn in range(rounds + 1):
            if turn == rounds:
                pairs = self.other_pairs(live, info)
            else:
                hubs = live.where(F.col("node") != F.col("hub"))
                pairs = hubs.select(F.col("node").alias("a"), F.col("hub").alias("b"))
                if not turn:
                    pairs = pairs.union(close)
                pairs = self.keep(pairs.distinct())
            edges = self.linked(pairs, info)
            if roots is not None:
                edges = edges.union(roots.select("node", "root"))
            roots = self.keep(components(edges, "a", "b"))
            if turn < rounds:
                self.scratch.drop(pairs)
                info = self.with_roots(roots)
                before, live = live, self.live_under(live, info)
                self.scratch.drop(before)
        return roots


def _may_link(size_a: str, size_b: str, bits_a: str, bits_b: str) -> Column:
    """False only for pairs that sizes or sketches show to be below four fifths."""
    sizes = [F.col(size_a), F.col(size_b)]
    near = 5 * F.least(*sizes) >= 4 * F.greatest(*sizes)
    # sketches of sizes this near have as many bits, or one has twice as many
    words = F.least(F.size(bits_a), F.size(bits_b))

    def folded(bits: Column) -> Column:
        halves = F.zip_with(
            F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y)
        )
        return F.when(F.size(bits) > words, halves).otherwise(bits)

    differing = F.aggregate(
        F.zip_with(folded(F.col(bits_a)), folded(F.col(bits_b)), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
        F.lit(0),
        lambda total, n: total + n,
    )
    return F.when(near, 9 * differing <= sizes[0] + sizes[1]).otherwise(F.lit(False))


def similar_groups(
    docs: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    cell: int = CELL,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``docs`` with component_id: the least id that links can reach, null if there is none.

    A null text counts as empty; texts without words are near duplicates of each other.
    A column with the result's name is replaced, others stay, whatever their names.
    """
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    texts = docs.select(F.col(row_id).alias("id"), F.col(text).alias("content"), digest.alias("digest"))
    key, size = free_name("digest", docs.columns), free_name("n_rows", docs.columns)
    with Scratch(docs.sparkSession) as scratch:
        search = _Search(texts, shingle, cell, scratch)
        linked = scratch.keep(search.roots(rounds).join(search.nodes, "node").select("node", "root", "least_id"))
        named = name_components(linked, scratch)
        # rows alone with their text and links are their own component and need no group
        groups = materialize(
            search.nodes.join(named, "node", "left")
            .where("n_rows > 1 or component_id is not null")
            .select(
                F.col("digest").alias(key), F.col("n_rows").alias(size),
                F.coalesce("component_id", "least_id").alias("component_id"),
                F.lit(True).alias("grouped"),
            )
        )
    marked = free_name("grouped", docs.columns)
    groups = groups.withColumnRenamed("grouped", marked)
    rows = docs.drop("component_id").withColumn(key, digest)
    found = attach_few_groups(rows, groups, key, size, F.col(row_id))
    component = F.when(F.col(marked), F.col("component_id")).otherwise(F.col(row_id))
    return found.withColumn("component_id", component).drop(key, size, marked)


def remove_near_copies(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, cell: int = CELL
) -> DataFrame:
    """One row of each group of near duplicates, the one with the least id.

    Rows that share that id stay together, as do rows of a group in which none has an id.
    Null, empty and wordless texts are one group; no rows give none. Other columns of
    ``docs`` may have any names.
    """
    hidden, back = set_aside(docs, row_id, text)
    grouped = similar_groups(hidden, row_id, text, shingle, cell)
    return back(grouped.where(F.col(row_id).eqNullSafe(F.col("component_id"))))
