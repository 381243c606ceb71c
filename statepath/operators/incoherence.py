"""How much the rows of a (state, action) disagree about what comes next."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.functions import js_divergence, vector_element
from statepath.storage import join_lookup

PAIR = ("CLUSTER", "ACTION")


def stddev_incoherence(steps: DataFrame, min_obs: int = 500) -> DataFrame:
    """Sample standard deviation of NEXT_CLUSTER per (CLUSTER, ACTION)."""
    known = steps.where(F.col("NEXT_CLUSTER").isNotNull())
    return (
        known.groupBy(*PAIR)
        .agg(F.stddev("NEXT_CLUSTER").alias("incoherence"), F.count(F.lit(1)).alias("cnt"))
        .where((F.col("cnt") >= min_obs) & F.col("incoherence").isNotNull())
        .orderBy(F.desc("incoherence"), *PAIR)
    )


def mean_distribution(rows: DataFrame, size: int, vector: str = "prob", keys=PAIR) -> DataFrame:
    """Elementwise mean of the vectors of each group, as ``mean`` of length ``size``."""
    means = [F.avg(vector_element(F.col(vector), i)) for i in range(size)]
    return rows.groupBy(*keys).agg(F.array(*means).alias("mean"))


def information_radius(
    rows: DataFrame, size: int, vector: str = "prob", limit: int | None = None
) -> DataFrame:
    """Mean Jensen-Shannon divergence of each row's vector to its group's mean.

    Two passes with partial aggregation: the means, then the divergences. No
    group is ever gathered; the small table of means is what travels.
    """
    known = rows.where(F.col("NEXT_CLUSTER").isNotNull())
    options = {} if limit is None else {"limit": limit}
    paired = join_lookup(
        known,
        mean_distribution(known, size, vector),
        PAIR,
        salt_by=["ID", "TIME"],
        width=size,
        **options,
    )
    divergence = js_divergence(F.col(vector), F.col("mean"))
    return (
        paired.groupBy(*PAIR)
        .agg(F.avg(divergence).alias("incoherence"), F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("incoherence"), *PAIR)
    )


def rank_incoherence(
    incoherence: DataFrame, min_obs: int, tried: Iterable[tuple[int, int]] = ()
) -> DataFrame:
    """Pairs with enough rows that were not tried yet, most incoherent first."""
    left = incoherence.where(F.col("cnt") >= min_obs)
    for cluster, action in tried:
        left = left.where((F.col("CLUSTER") != cluster) | (F.col("ACTION") != action))
    return left.orderBy(F.desc("incoherence"), *PAIR)


def worst_action(
    rows: DataFrame, size: int, vector: str = "prob", min_obs: int = 0
) -> DataFrame:
    """The most incoherent action of each half (SUB), of those with ``min_obs`` known rows."""
    halves = rows.withColumn("CLUSTER", F.col("SUB"))
    order = F.struct(F.col("incoherence"), -F.col("ACTION"))
    return (
        information_radius(halves, size, vector)
        .where(F.col("cnt") >= min_obs)
        .groupBy(F.col("CLUSTER").alias("SUB"))
        .agg(
            F.max_by("ACTION", order).alias("ACTION"),
            F.max("incoherence").alias("incoherence"),
        )
    )
