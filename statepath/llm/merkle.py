"""Merkle manifest of a dataset: a root for all rows and a witness for each.

Rows are leaves of one tree per group (a language, say); the roots of the groups, in the
order of their names, are the leaves of one more tree. Each ``ARITY`` consecutive nodes,
the last run fewer, become their parent while a level has several nodes. A digest is the
SHA-256 of the digests below it, concatenated as hex text.

Witnesses are built incrementally. A tree only ever appends: a node joins the open run of
its level, and once the run is complete its parent is appended to the level above, while
the witness of every item below takes the siblings in. Leaves are appended block by block,
in parallel; a block is an aligned subtree of ``ARITY ** LEVELS`` leaves, so its root is an
append to a tree of block roots, whose witnesses extend those of all leaves of the block.
No task ever holds more than one block, and witnesses of leaves are not stored, only those
of blocks: the last pass appends the leaves of a block once more and folds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.llm.common import ship_code
from statepath.storage import materialize

ARITY = 8
LEVELS = 4
WITNESS = "array<struct<before:string,after:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` items until one node remains."""
    levels = 0
    while ARITY**levels < n:
        levels += 1
    return levels


class Appender:
    """Open subtrees of a tree and the partial witness of every item appended so far.

    A witness lists, for each level that is closed above its item, the digests of the
    siblings before and after.
    """

    def __init__(self) -> None:
        self.witnesses: list[list[tuple[str, str]]] = []
        # of each level, the nodes of its open run: digest, first item, end of items
        self._open: list[list[tuple[str, int, int]]] = [[]]

    def append(self, item: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._join(0, (item, at, at + 1))

    def _join(self, level: int, node: tuple[str, int, int]) -> None:
        if level == len(self._open):
            self._open.append([])
        self._open[level].append(node)
        if len(self._open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self._open[level] = self._open[level], []
        digests = [node[0] for node in run]
        for i, (_, first, end) in enumerate(run):
            siblings = ("".join(digests[:i]), "".join(digests[i + 1 :]))
            for item in range(first, end):
                self.witnesses[item].append(siblings)
        self._join(level + 1, (digest(*digests), run[0][1], run[-1][2]))

    def finish(self, levels: int) -> str:
        """Close what is open below ``levels``, be it a single node, and return the root there."""
        for level in range(levels):
            if level < len(self._open) and self._open[level]:
                self._close(level)
        return self._open[levels][0][0]


def fold(item: str, witness: Sequence[tuple[str, str]]) -> str:
    """The root that an item and its witness lead to."""
    for before, after in witness:
        item = digest(before, item, after)
    return item


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    length = F.octet_length(value).cast("string")
    return F.coalesce(F.concat(length, F.lit(":"), value), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    """Digest of the values one after the other; null and empty ones differ."""
    return F.sha2(F.concat(*[encoded(c) for c in columns]), 256)


def group_key(column: str) -> Column:
    """A key that is never null and sorts as the column does, null first."""
    return F.coalesce(F.concat(F.lit("1"), F.col(column).cast("string")), F.lit("0"))


def number_items(items: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``items`` (tree, ...) with pos in the tree, from 0, by ``order``, and n, the tree's size.

    Items are sorted in ranges, so a tree with most of them is spread; the counts of the
    ranges give every range its first position.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # repeated items differ in the last key alone, and so can be in several ranges
    keys = [F.col("tree"), *order, F.monotonically_increasing_id()]
    keyed = items.select("*", *[k.alias(f"_key_{i}") for i, k in enumerate(keys[1:])])
    names = ["tree", *[F.col(f"_key_{i}").asc_nulls_first() for i in range(len(keys) - 1)]]
    ranged = (
        keyed.repartitionByRange(parts, *names)
        .sortWithinPartitions(*names)
        .select(*items.columns, F.spark_partition_id().alias("part"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    ranged = materialize(ranged)
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("tree", "part")
        .agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
        .withColumn("start", F.coalesce(F.sum("size").over(earlier), F.lit(0)) - F.col("first"))
        .withColumn("n", F.sum("size").over(Window.partitionBy("tree")))
        .select("tree", "part", "start", "n")
    )
    return ranged.join(starts, ["tree", "part"]).select(
        *items.columns, (F.col("start") + F.col("at")).alias("pos"), "n"
    )


def _blocks(items: DataFrame, levels: int) -> DataFrame:
    return items.withColumn("block", F.floor(F.col("pos") / F.lit(ARITY**levels)).cast("long"))


def _appended(table: pa.Table, levels: int) -> tuple[pa.Table, Appender, str]:
    """The items of one block in order, appended."""
    table = table.sort_by("pos")
    tree = Appender()
    for item in table.column("digest").to_pylist():
        tree.append(item.hex())
    n = table.column("n")[0].as_py()
    return table, tree, tree.finish(min(levels, depth(n)))


def _block_roots(items: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, digest) of the roots of the blocks, as the items one stage higher."""

    def build(table: pa.Table) -> pa.Table:
        table, _, root = _appended(table, levels)
        first = table.slice(0, 1)
        n = -(-first.column("n")[0].as_py() // ARITY**levels)
        return pa.table(
            {
                "tree": first.column("tree").cast(pa.string()),
                "pos": first.column("block"),
                "n": pa.array([n], pa.int64()),
                "digest": pa.array([bytes.fromhex(root)], pa.binary()),
            }
        )

    rows = _blocks(items, levels).select("tree", "block", "pos", "n", "digest")
    return rows.groupBy("tree", "block").applyInArrow(
        build, "tree string, pos long, n long, digest binary"
    )


def _stage_witnesses(items: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, witness) of items: within their block, then what is ``above`` the block."""

    def build(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, tree, _ = _appended(table, levels)
        rest = upper.column("witness")[0].as_py()
        found = [
            [{"before": b, "after": a} for b, a in own] + rest for own in tree.witnesses
        ]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table(
            {
                "tree": table.column("tree").cast(pa.string()),
                "pos": table.column("pos"),
                "witness": pa.array(found, kind),
            }
        )

    rows = _blocks(items, levels).select("tree", "block", "pos", "n", "digest")
    upper = above.select("tree", F.col("pos").alias("block"), "witness")
    return (
        rows.groupBy("tree", "block")
        .cogroup(upper.groupBy("tree", "block"))
        .applyInArrow(build, f"tree string, pos long, witness {WITNESS}")
    )


class Manifest(NamedTuple):
    """The digests of a dataset.

    ``leaves``: the rows' columns with tree, pos, n and digest; ``trees``: tree, digest of
    its root; ``blocks``: tree, pos (of a block), witness from the block's root to the
    root of all; ``root``: null for an empty dataset; ``levels`` of a block.
    """

    levels: int
    leaves: DataFrame
    trees: DataFrame
    blocks: DataFrame
    root: str | None


def _tree_roots(items: DataFrame, levels: int) -> list[DataFrame]:
    """The stages of items above ``items``; the last one has one item for each tree."""
    stages = [items]
    while True:
        stages.append(materialize(_block_roots(stages[-1], levels)))
        if stages[-1].where("n > 1").isEmpty():
            return stages


def _witnesses_down(stages: list[DataFrame], witness: DataFrame, levels: int) -> DataFrame:
    """From the witnesses of the roots (tree, pos = 0, witness) to those of the blocks below."""
    for items in reversed(stages[1:-1]):
        witness = materialize(_stage_witnesses(items, witness, levels))
    return witness


def build_manifest(
    rows: DataFrame, order: Sequence[Column], levels: int = LEVELS
) -> Manifest:
    """Number and append ``rows`` (tree, digest binary, any others), then the trees' roots.

    Rows of a tree are in the order of ``order``, nulls first.
    """
    ship_code(rows.sparkSession)
    leaves = materialize(number_items(rows, order))
    stages = _tree_roots(leaves, levels)
    trees = stages[-1].select("tree", "digest")

    # a stage's trees can end earlier than others: their single item is a block of one
    named = trees.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    tops = materialize(number_items(named, [F.col("name")]))
    top_stages = _tree_roots(tops, levels)
    found = top_stages[-1].first()
    root = None if found is None else found.digest.hex()
    above_all = top_stages[-1].select("tree", "pos", F.array().cast(WITNESS).alias("witness"))
    above_tops = _witnesses_down(top_stages, above_all, levels)
    of_trees = _stage_witnesses(tops, above_tops, levels).join(tops.select("pos", "name"), "pos")
    of_trees = of_trees.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "witness")
    blocks = _witnesses_down(stages, materialize(of_trees), levels)
    return Manifest(levels, leaves, trees, blocks, root)


def verify(manifest: Manifest, claimed: str = "claimed", carry: Sequence[str] = ()) -> DataFrame:
    """Fold each row's ``claimed`` digest (hex; null: its own) with its witness.

    Returns the columns ``carry`` of the leaves, leaf, subroot, root, proof_sha256 (digest
    of the witness), folded_root and verified. An empty dataset gives no rows.
    """
    levels = manifest.levels
    leaves = _blocks(manifest.leaves, levels).select("tree", "block", "pos", "n", "digest", claimed, *carry)
    upper = manifest.blocks.select("tree", F.col("pos").alias("block"), "witness").join(
        manifest.trees.select("tree", F.col("digest").alias("subroot")), "tree"
    )
    root = manifest.root
    results = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    schema = manifest.leaves.select(
        *carry, *[F.lit("").alias(c) for c in results[:-1]], F.lit(True).alias("verified")
    ).schema

    def build(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, tree, _ = _appended(table, levels)
        rest = [(w["before"], w["after"]) for w in upper.column("witness")[0].as_py()]
        own = [item.hex() for item in table.column("digest").to_pylist()]
        shown = [c if c is not None else o for c, o in zip(table.column(claimed).to_pylist(), own)]
        proofs, folded = [], []
        for item, within in zip(shown, tree.witnesses):
            proofs.append(digest(*[s for pair in (*within, *rest) for s in pair]))
            folded.append(fold(item, (*within, *rest)))
        subroot = upper.column("subroot")[0].as_py().hex()
        n = table.num_rows
        columns = [own, [subroot] * n, [root] * n, proofs, folded, [f == root for f in folded]]
        return pa.table(
            {c: table.column(c) for c in carry}
            | {name: pa.array(values) for name, values in zip(results, columns)}
        )

    return (
        leaves.groupBy("tree", "block")
        .cogroup(upper.groupBy("tree", "block"))
        .applyInArrow(build, schema)
    )


def witness_rows(
    docs: DataFrame,
    leaf: Column,
    group: str,
    row_id: str = "doc_id",
    claimed: Column | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """The manifest of ``docs`` and, for every row, the check of its witness.

    ``leaf`` is a row's digest as hex text (see leaf_digest); rows of a group ascend by
    ``row_id``, null first, equal ones by leaf. ``claimed`` is the digest that is folded
    (null: the row's own). A null group is one of its own, before all others; repeated
    rows are a leaf each; no rows give none. Returns ``row_id`` and the results of verify;
    other columns, whatever their names, have no part in this and are not returned.
    """
    if row_id in ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"):
        raise ValueError(f"{row_id} is a result; rename the input")
    rows = docs.select(
        group_key(group).alias("tree"),
        F.unhex(leaf).alias("digest"),
        (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed"),
        F.col(row_id).alias("id"),
    )
    manifest = build_manifest(rows, [F.col("id"), F.col("digest")], levels)
    return verify(manifest, carry=["id"]).withColumnRenamed("id", row_id)
