"""Probability of ending in each absorbing state.

States of large processes are eliminated (see ``eliminate``) until few are left or
the rest is dense. That rest, as every small matrix, is squared until the mass still
on the move is below the tolerance: k rounds look 2^k steps ahead. Mass is on the
move in states that are no end but can reach one. Matrices of at most
``FOLD_STATES`` states are squared inside one expression, one row per process; dense
ones by self-joins. Rows are scaled to 1 after each round, so that rounding does not
add up. A matrix that has not settled after 2^ROUNDS steps is an error, never a
short answer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statepath.operators.decision import chain_steps, find_absorbing
from statepath.plans.eliminate import eliminate_states
from statepath.storage import materialize

FOLD_STATES = 64
ROUNDS = 64


def _states(matrix: DataFrame, by: Sequence[str]) -> DataFrame:
    columns = matrix.select(*by, F.col("NEXT_CLUSTER").alias("CLUSTER"))
    return matrix.select(*by, "CLUSTER").union(columns).distinct()


def _pack(matrix: DataFrame, absorbing: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per process: (by, states, ends, m) with the dense matrix m."""
    flagged = _states(matrix, by).join(
        absorbing.withColumn("ends", F.lit(True)), [*by, "CLUSTER"], "left"
    )
    listed = flagged.groupBy(*by).agg(
        F.array_sort(
            F.collect_list(F.struct("CLUSTER", F.coalesce("ends", F.lit(False)).alias("ends")))
        ).alias("states")
    )
    rows = listed.select(*by, F.explode("states.CLUSTER").alias("CLUSTER"), "states")
    cells = rows.select(
        *by, "CLUSTER", F.explode("states.CLUSTER").alias("NEXT_CLUSTER")
    ).join(matrix, [*by, "CLUSTER", "NEXT_CLUSTER"], "left")
    cell = F.struct("NEXT_CLUSTER", F.coalesce("prob", F.lit(0.0)).alias("p"))
    dense_rows = cells.groupBy(*by, "CLUSTER").agg(
        F.array_sort(F.collect_list(cell)).alias("cells")
    )
    dense = dense_rows.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("CLUSTER", F.col("cells.p").alias("p")))).alias("m")
    )
    if by:
        joined = listed.join(dense, list(by))
    else:
        joined = dense.withColumn("states", listed.scalar())
    return joined.select(*by, "states", F.col("m.p").alias("m"))


def _fold_squares(packed: DataFrame, tol: float, rounds: int) -> DataFrame:
    places = F.sequence(F.lit(0), F.size("states") - 1)

    def times(row, m):
        return F.transform(
            places,
            lambda j: F.aggregate(
                places, F.lit(0.0), lambda acc, k: acc + F.get(row, k) * F.get(F.get(m, k), j)
            ),
        )

    def total(values):
        return F.aggregate(values, F.lit(0.0), lambda acc, p: acc + p)

    def scaled(row):
        return F.transform(row, lambda p: F.coalesce(p / F.nullif(total(row), F.lit(0.0)), p))

    def moving(m):
        """Largest mass any state has on states that are no end but reach one."""
        reaches = F.transform(
            m,
            lambda row: F.exists(
                F.zip_with(row, "states", lambda p, s: s["ends"] & (p > 0)), lambda ok: ok
            ),
        )
        open_ = F.zip_with(reaches, "states", lambda ok, s: ok & ~s["ends"])
        left = F.transform(
            m,
            lambda row: total(F.zip_with(row, open_, lambda p, o: F.when(o, p).otherwise(0.0))),
        )
        return F.array_max(left)

    def once(m, number):
        # 2^least steps see every end that can be reached at all
        done = (F.pow(F.lit(2.0), number - 1) >= F.size("states")) & (moving(m) <= tol)
        return F.when(done, m).otherwise(F.transform(m, lambda row: scaled(times(row, m))))

    squared = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("m"), once)
    return packed.withColumn("m", squared).withColumn("moving", moving(F.col("m")))


def _unpack(packed: DataFrame, by: Sequence[str]) -> DataFrame:
    ids = F.col("states.CLUSTER")
    rows = F.arrays_zip(ids.alias("CLUSTER"), F.col("m").alias("row"))
    cells = F.arrays_zip(F.col("ids").alias("NEXT_CLUSTER"), F.col("row").alias("prob"))
    return (
        packed.select(*by, ids.alias("ids"), F.inline(rows))
        .select(*by, "CLUSTER", F.inline(cells))
        .where("prob <> 0")
    )


def square_matrix(matrix: DataFrame, rounds: int, by: Sequence[str] = ()) -> DataFrame:
    """The matrix to the power 2^rounds, by self-joins."""
    row = Window.partitionBy(*by, "CLUSTER")
    for _ in range(rounds):
        matrix = materialize(
            chain_steps(matrix, matrix, by).withColumn("prob", F.col("prob") / F.sum("prob").over(row))
        )
    return matrix


def _unsettled():
    return RuntimeError(f"mass is still on the move after 2^{ROUNDS} steps")


def _square_until_absorbed(matrix, absorbing, tol, rounds, by, states):
    """As the folded form, with self-joins; ``states`` is the largest number of states."""
    ends = absorbing.select(*by, F.col("CLUSTER").alias("NEXT_CLUSTER"))
    for number in range(rounds + 1):
        if number >= math.ceil(math.log2(max(2, states))):
            reaches = matrix.join(ends, [*by, "NEXT_CLUSTER"], "left_semi").where("prob > 0")
            open_ = reaches.select(*by, F.col("CLUSTER").alias("NEXT_CLUSTER")).distinct()
            moving = (
                matrix.join(ends, [*by, "NEXT_CLUSTER"], "left_anti")
                .join(open_, [*by, "NEXT_CLUSTER"], "left_semi")
                .groupBy(*by, "CLUSTER")
                .agg(F.sum("prob").alias("mass"))
            )
            if moving.where(F.col("mass") > tol).isEmpty():
                return matrix
        matrix = square_matrix(matrix, 1, by)
    raise _unsettled()


def refuse_invalid(matrix: DataFrame, by: Sequence[str] = ()) -> None:
    """An error if a row does not sum to 1, a probability is negative, or a row is missing."""
    sums = matrix.groupBy(*by, "CLUSTER").agg(
        F.sum("prob").alias("total"), F.min("prob").alias("least")
    )
    asked = _states(matrix, by).join(sums, [*by, "CLUSTER"], "left")
    fine = (F.abs(F.col("total") - 1) <= 1e-6) & (F.col("least") >= -1e-12)
    found = asked.where(~F.coalesce(fine, F.lit(False))).select(*by, "CLUSTER", "total").limit(5)
    bad = found.collect()
    if bad:
        raise ValueError(f"rows of these states are missing, negative or do not sum to 1: {bad}")


def absorption_probabilities(
    matrix: DataFrame,
    tol: float = 1e-12,
    by: Sequence[str] = (),
    rounds: int = ROUNDS,
    fold_states: int = FOLD_STATES,
) -> DataFrame:
    """(CLUSTER, END_STATE, prob) for every start state; end states are one-hot.

    States that can circle forever without reaching an end keep their mass out of
    the result; ``check_reachable`` lists them. An invalid matrix is refused.
    """
    matrix = materialize(matrix)
    refuse_invalid(matrix, by)
    absorbing = materialize(find_absorbing(matrix, tol, by))
    if _widest(matrix, by) <= fold_states:
        return _squared(matrix, absorbing, tol, by, rounds, fold_states)

    def solve_rest(rest: DataFrame) -> DataFrame:
        ends = rest.where("CLUSTER = NEXT_CLUSTER").select(*by, "CLUSTER")
        return _squared(rest, ends, tol, by, rounds, fold_states)

    return eliminate_states(matrix, absorbing, by, solve_rest, fold_states)


def _widest(matrix: DataFrame, by: Sequence[str]) -> int:
    """The largest number of states of a process."""
    return _states(matrix, by).groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def _squared(matrix, absorbing, tol, by, rounds, fold_states) -> DataFrame:
    widest = _widest(matrix, by)
    if widest <= fold_states:
        packed = _pack(matrix, absorbing, by)
        squared = materialize(_fold_squares(packed, tol, rounds))
        if not squared.where(F.col("moving") > tol).isEmpty():
            raise _unsettled()
        reached = _unpack(squared, by)
    else:
        reached = _square_until_absorbed(matrix, absorbing, tol, rounds, by, widest)
    ends = absorbing.select(
        *by, F.col("CLUSTER").alias("NEXT_CLUSTER"), F.col("CLUSTER").alias("END_STATE")
    )
    return reached.join(ends, [*by, "NEXT_CLUSTER"]).select(*by, "CLUSTER", "END_STATE", "prob")
