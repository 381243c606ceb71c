"""Checks that return the violating rows; an empty result is a pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_step_keys(steps: DataFrame) -> DataFrame:
    """How many rows break the contract of a step table, by kind, in one aggregate.

    Ordered operators need (ID, TIME) to be a key: of rows that repeat one, which comes
    next is arbitrary, and the number of rows in a time slice has no bound.
    """
    given = "CLUSTER" in steps.columns
    keys = steps.groupBy("ID", "TIME").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("CLUSTER").isNull() if given else F.lit(False)).alias("no_state"),
    )
    whole = F.col("ID").isNotNull() & F.col("TIME").isNotNull()
    kinds = {
        "no subject": F.sum(F.when(F.col("ID").isNull(), F.col("n"))),
        "no time": F.sum(F.when(F.col("TIME").isNull(), F.col("n"))),
        "negative time": F.sum(F.when(F.col("TIME") < 0, F.col("n"))),
        "repeated key": F.sum(F.when(whole & (F.col("n") > 1), F.col("n"))),
        "no given state": F.sum("no_state"),
    }
    counted = keys.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in kinds.items()])
    pairs = [F.struct(F.lit(k).alias("problem"), F.col(f"`{k}`").alias("n_rows")) for k in kinds]
    return counted.select(F.inline(F.array(*pairs)))


def check_row_sums(matrix: DataFrame, states: DataFrame, tol: float = 1e-10) -> DataFrame:
    """States whose outgoing probabilities do not sum to 1; a missing row sums to 0."""
    sums = matrix.groupBy("CLUSTER").agg(F.sum("prob").alias("total"))
    return (
        states.select("CLUSTER")
        .distinct()
        .join(sums, "CLUSTER", "left")
        .select("CLUSTER", F.coalesce("total", F.lit(0.0)).alias("total"))
        .where(F.abs(F.col("total") - 1) > tol)
    )


def check_nonnegative(matrix: DataFrame, tol: float = 1e-12) -> DataFrame:
    return matrix.where(F.col("prob") < -tol)


def check_square(matrix: DataFrame) -> DataFrame:
    """States that are only a row or only a column of the matrix."""
    rows = matrix.select(F.col("CLUSTER").alias("state")).distinct()
    columns = matrix.select(F.col("NEXT_CLUSTER").alias("state")).distinct()
    only_row = rows.join(columns, "state", "left_anti").withColumn("side", F.lit("row"))
    only_column = columns.join(rows, "state", "left_anti").withColumn("side", F.lit("column"))
    return only_row.unionByName(only_column)


def check_absorbing(matrix: DataFrame, absorbing: DataFrame) -> DataFrame:
    """Number of states and absorbing states, and whether any end can be reached."""
    states = matrix.select("CLUSTER").union(matrix.select("NEXT_CLUSTER")).distinct()
    flagged = states.join(absorbing.withColumn("absorbs", F.lit(1)), "CLUSTER", "left")
    n_absorbing = F.count("absorbs")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_states"),
        n_absorbing.alias("n_absorbing"),
        (n_absorbing > 0).alias("has_absorbing"),
        (n_absorbing == F.count(F.lit(1))).alias("is_identity"),
    )


def check_reachable(absorption: DataFrame, matrix: DataFrame, tol: float = 1e-6) -> DataFrame:
    """States that never reach an end state with certainty: mass left over after absorption."""
    absorbed = absorption.groupBy("CLUSTER").agg(F.sum("prob").alias("absorbed"))
    residual = 1 - F.coalesce(F.col("absorbed"), F.lit(0.0))
    return (
        matrix.select("CLUSTER")
        .distinct()
        .join(absorbed, "CLUSTER", "left")
        .select("CLUSTER", residual.alias("residual"))
        .where(F.col("residual") > tol)
    )


def check_action_rows(
    transitions: DataFrame, pairs: DataFrame, tol: float = 1e-10
) -> DataFrame:
    """Requested (CLUSTER, ACTION) without transitions, or not summing to 1."""
    sums = transitions.groupBy("CLUSTER", "ACTION").agg(F.sum("prob").alias("total"))
    return (
        pairs.select("CLUSTER", "ACTION")
        .distinct()
        .join(sums, ["CLUSTER", "ACTION"], "left")
        .select("CLUSTER", "ACTION", F.coalesce("total", F.lit(0.0)).alias("total"))
        .where(F.abs(F.col("total") - 1) > tol)
    )
