"""Connected components of a graph by alternating large-star and small-star steps.

The hub of a large component is a hot key. Its least neighbour is found with partial
aggregation and attached to its edges by a join with salts. Tables of earlier steps are
deleted as soon as the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import attach_groups
from statepath.storage import Scratch, materialize


def _with_minimum(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Directed edges (u, v) with m, the least of u and all its v."""
    least = edges.groupBy("u").agg(
        F.least(F.first("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("n")
    )
    return attach_groups(edges, least, "u", "n", F.col("v"), "inner", keep=scratch.keep)


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of u is linked to the least neighbour of u."""
    both = edges.select(
        F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    ).select("col.u", "col.v")
    return _with_minimum(both, scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    linked = _with_minimum(edges, scratch).select(F.explode(ends)).select("col.u", "col.v")
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): every node of an edge with the least node that it can reach."""
    stars = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    stars = stars.where("u <> v").distinct()
    with Scratch(edges.sparkSession) as scratch:
        stars = scratch.keep(stars)
        before = None
        while True:
            found = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
            if not found[0] or found == before:
                break
            before = found
            with Scratch(edges.sparkSession) as step:
                larger = step.keep(_large_star(stars, step))
                smaller = scratch.keep(_small_star(larger, step))
            scratch.drop(stars)
            stars = smaller
        nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return materialize(nodes.union(stars.select("v", "v").distinct()))
