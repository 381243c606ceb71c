"""Reports on states, actions and features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.operators.ordering import time_slice

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def time_profile(steps: DataFrame) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max of TIME per state.

    Quartiles come from the counts per (state, TIME): ranks are accumulated
    inside time slices of bounded length on top of the slices' own totals, so no
    task sees a whole state and no value is approximated.
    """
    counts = steps.groupBy("CLUSTER", time_slice().alias("_slice"), "TIME").agg(
        F.count(F.lit(1)).alias("n")
    )
    by_slice = Window.partitionBy("CLUSTER").orderBy("_slice")
    whole = Window.partitionBy("CLUSTER")
    slices = (
        counts.groupBy("CLUSTER", "_slice")
        .agg(F.sum("n").alias("rows"))
        .withColumn("below", F.sum("rows").over(by_slice) - F.col("rows"))
        .withColumn("total", F.sum("rows").over(whole))
        .drop("rows")
    )
    inside = Window.partitionBy("CLUSTER", "_slice").orderBy("TIME")
    ranked = (
        counts.withColumn("upto", F.sum("n").over(inside))
        .join(slices, ["CLUSTER", "_slice"])
        .withColumn("last", F.col("below") + F.col("upto") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(rank.between(F.col("first"), F.col("last")), F.col("TIME")))

    picks = []
    for name, q in QUARTILES.items():
        place = F.lit(q) * (F.col("total") - 1)
        picks += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi")]
        picks.append(F.max(place - F.floor(place)).alias(f"{name}_part"))
    quartiles = ranked.groupBy("CLUSTER").agg(*picks)
    moments = steps.groupBy("CLUSTER").agg(
        F.count("TIME").alias("cnt"),
        F.avg("TIME").alias("mean"),
        F.stddev("TIME").alias("std"),
        F.min("TIME").alias("min"),
        F.max("TIME").alias("max"),
    )
    values = [
        (F.col(f"{q}_lo") + F.col(f"{q}_part") * (F.col(f"{q}_hi") - F.col(f"{q}_lo"))).alias(q)
        for q in QUARTILES
    ]
    return moments.join(quartiles, "CLUSTER").select(
        "CLUSTER", "cnt", "mean", "std", "min", *values, "max"
    )


def time_histogram(steps: DataFrame, upper: int = 2000, bins: int = 100) -> DataFrame:
    """Rows per state and equal-width TIME bin; the right edge belongs to the last bin."""
    inside = steps.where(F.col("TIME").between(0, upper))
    place = F.floor(F.col("TIME") / F.lit(upper / bins))
    return inside.groupBy("CLUSTER", F.least(place, F.lit(bins - 1)).cast("int").alias("BIN")).agg(
        F.count(F.lit(1)).alias("cnt")
    )


def action_frequency(steps: DataFrame) -> DataFrame:
    counts = steps.where(F.col("ACTION").isNotNull()).groupBy("ACTION").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    total = counts.agg(F.sum("cnt")).scalar()
    return counts.select("ACTION", (F.col("cnt") / total).alias("freq"))


def expand_grid(df: DataFrame, key: str, categories: Sequence[int], column: str) -> DataFrame:
    """Every present ``key`` with every category; the values of ``df`` or null."""
    listed = F.explode(F.array(*[F.lit(c) for c in categories]))
    grid = df.select(key).distinct().withColumn(column, listed)
    return grid.join(df, [key, column], "left")


def action_frequency_by_state(steps: DataFrame, actions: Sequence[int]) -> DataFrame:
    """Share of each listed action in all rows of a state; 0 for actions it never took."""
    counts = steps.groupBy("CLUSTER", "ACTION").agg(F.count(F.lit(1)).alias("cnt"))
    state = Window.partitionBy("CLUSTER")
    shares = counts.withColumn("freq", F.col("cnt") / F.sum("cnt").over(state)).drop("cnt")
    filled = expand_grid(shares, "CLUSTER", actions, "ACTION")
    return filled.select("CLUSTER", "ACTION", F.coalesce("freq", F.lit(0.0)).alias("freq"))


def feature_zscores(steps: DataFrame, features: Sequence[str]) -> DataFrame:
    """(state mean - overall mean) / overall sample std, per (feature, CLUSTER).

    One pass takes count, mean and variance per state; the overall moments are
    merged from those, and only that small table is turned from wide to long.
    """
    parts = []
    for name in features:
        number = F.col(f"`{name}`").cast("double")
        value = F.when(~F.isnan(number), number)
        moments = F.struct(
            F.lit(name).alias("feature"),
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.var_pop(value).alias("var"),
        )
        parts.append(moments)
    states = steps.groupBy("CLUSTER").agg(F.array(*parts).alias("parts"))
    long = states.select("CLUSTER", F.inline("parts"))
    merged = long.groupBy("feature").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mu")
    )
    within = F.col("n") * (F.col("var") + F.pow(F.col("mean") - F.col("mu"), F.lit(2)))
    overall = (
        long.join(merged, "feature")
        .groupBy("feature", "mu", "total")
        .agg(F.sqrt(F.sum(within) / F.nullif(F.col("total") - 1, F.lit(0))).alias("sd"))
    )
    score = (F.col("mean") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    return long.join(overall, "feature").select("feature", "CLUSTER", score.alias("zscore"))


def wide_matrix(
    df: DataFrame, row: str, column: str, value: str, names: Sequence[int], prefix: str = ""
) -> DataFrame:
    """Long to wide, one column per listed name."""
    wide = df.groupBy(row).pivot(column, list(names)).agg(F.max(value))
    return wide.withColumnsRenamed({str(n): f"{prefix}{n}" for n in names})
