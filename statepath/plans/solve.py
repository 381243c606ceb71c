"""Value iteration for the minimum-risk policy.

P and R are summaries: their size follows the number of states, not the data.
A process of at most ``FOLD_ROWS`` transitions is packed into one row and swept
inside one expression, so hundreds of sweeps cost one job and many processes
(``by``) run side by side. Larger ones are swept with joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statepath.operators.decision import (
    required,
    attach_reward,
    bellman_backup,
    best_action,
    greedy_values,
    initial_values,
)
from statepath.storage import fits_broadcast, materialize

FOLD_ROWS = 10_000
FOLD_BLOCKS = 160
# Sweeps between two looks at how far the values have moved, in either form.
BLOCK = 6
ULP = 2.0**-52


class Solution(NamedTuple):
    policy: DataFrame
    action_values: DataFrame
    values: DataFrame


def sweep(
    priced: DataFrame,
    values: DataFrame,
    gamma: float,
    by: Sequence[str] = (),
    fixed: DataFrame | None = None,
    small: bool = False,
) -> DataFrame:
    """V after one more Bellman sweep; values of states without actions are kept."""
    held = values if fixed is None else fixed
    better = greedy_values(bellman_backup(priced, values, gamma, by, small), by)
    kept = held.where("fixed").select(*by, "CLUSTER", "v", "fixed")
    return better.withColumn("fixed", F.lit(False)).unionByName(kept)


def run_sweeps(
    transitions: DataFrame,
    rewards: DataFrame,
    count: int,
    gamma: float = 0.9,
    by: Sequence[str] = (),
) -> DataFrame:
    """V after ``count`` sweeps from the start values."""
    priced = attach_reward(transitions, rewards, by)
    start = initial_values(transitions, rewards, by)
    values = start
    for _ in range(count):
        values = sweep(priced, values, gamma, by, fixed=start)
    return values.select(*by, "CLUSTER", "v")


def _settled(moved, v, epsilon: float):
    """No more movement than ``epsilon``, or than double precision can resolve."""
    return (moved < epsilon) | (moved <= 8 * ULP * F.abs(v))


def _pack(priced: DataFrame, start: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per process: its states in order, each with its actions and their moves."""
    order = Window.partitionBy(*by).orderBy("CLUSTER")
    placed = start.withColumn("at", (F.row_number().over(order) - 1).cast("int"))
    ahead = placed.select(*by, F.col("CLUSTER").alias("NEXT_CLUSTER"), "at")
    moves = (
        priced.join(ahead, [*by, "NEXT_CLUSTER"], "left")
        .withColumn("at", required("at", "no value for state ", "NEXT_CLUSTER"))
        .groupBy(*by, "CLUSTER", "ACTION")
        .agg(
            F.max("RISK").alias("risk"),
            F.array_sort(F.collect_list(F.struct("at", "prob"))).alias("moves"),
        )
        .groupBy(*by, "CLUSTER")
        .agg(F.collect_list(F.struct("risk", "moves")).alias("actions"))
    )
    state = F.struct("CLUSTER", "v", "fixed", "actions")
    return (
        placed.join(moves, [*by, "CLUSTER"], "left")
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(state)).alias("states"))
    )


def _fold_sweeps(packed: DataFrame, gamma: float, epsilon: float, blocks: int) -> DataFrame:
    """Up to so many blocks of sweeps of every process, stopping where its values settle."""

    def action_value(action, v):
        ahead = F.aggregate(
            action["moves"], F.lit(0.0), lambda acc, m: acc + m["prob"] * F.get(v, m["at"])
        )
        return action["risk"] + gamma * ahead

    def state_value(state, v):
        better = F.array_min(F.transform(state["actions"], lambda a: action_value(a, v)))
        return F.when(state["fixed"], state["v"]).otherwise(better)

    def once(at, number):
        v = F.transform("states", lambda s: state_value(s, at["v"]))
        looks = number % BLOCK == 0
        still = F.forall(
            F.zip_with(v, at["before"], lambda new, old: _settled(F.abs(new - old), new, epsilon)),
            lambda ok: ok,
        )
        return F.when(at["settled"], at).otherwise(
            F.struct(
                v.alias("v"),
                F.when(looks, v).otherwise(at["before"]).alias("before"),
                (looks & still).alias("settled"),
            )
        )

    start = F.transform("states", lambda s: s["v"])
    begin = F.struct(start.alias("v"), start.alias("before"), F.lit(False).alias("settled"))
    after = F.aggregate(F.sequence(F.lit(1), F.lit(blocks * BLOCK)), begin, once)
    return packed.withColumn("after", after)


def _solve_folded(priced, start, gamma, epsilon, by):
    packed = _pack(priced, start, by)
    while True:
        swept = materialize(_fold_sweeps(packed, gamma, epsilon, FOLD_BLOCKS))
        if swept.where("NOT after.settled").isEmpty():
            break
        renewed = F.zip_with("states", "after.v", lambda s, v: s.withField("v", v))
        packed = swept.select(*by, renewed.alias("states"))
    values = F.arrays_zip(F.col("states.CLUSTER").alias("CLUSTER"), F.col("after.v").alias("v"))
    return swept.select(*by, F.inline(values))


def _solve_joined(priced, start, gamma, epsilon, by, broadcast_limit):
    """Sweeps as joins: P stays partitioned by state, only V moves.

    A process whose values have settled leaves, so each stops where it would stop alone.
    """
    small = fits_broadcast(start, width=2 + len(by), **broadcast_limit)
    partitioned = priced.repartition(*by, "CLUSTER")
    before, settled = start, []
    while True:
        after = before
        for _ in range(BLOCK):
            after = sweep(partitioned, after, gamma, by, fixed=start, small=small)
        old = before.select(*by, "CLUSTER", F.col("v").alias("old"))
        moved = F.abs(F.col("v") - F.col("old"))
        after = materialize(
            after.join(old, [*by, "CLUSTER"]).withColumn(
                "settled", _settled(moved, F.col("v"), epsilon)
            )
        )
        before = after.select(*by, "CLUSTER", "v", "fixed")
        moving = after.where("NOT settled").select(*by).distinct() if by else None
        if after.where("NOT settled").isEmpty():
            return reduce(DataFrame.union, settled, before.select(*by, "CLUSTER", "v"))
        if by:
            moving = materialize(moving)
            settled.append(before.join(moving, list(by), "left_anti").select(*by, "CLUSTER", "v"))
            before, start, partitioned = (
                x.join(moving, list(by), "left_semi") for x in (before, start, partitioned)
            )


def solve_policy(
    transitions: DataFrame,
    rewards: DataFrame,
    gamma: float = 0.9,
    epsilon: float = 1e-10,
    by: Sequence[str] = (),
    fold_rows: int = FOLD_ROWS,
    broadcast_limit: int | None = None,
) -> Solution:
    """The minimum-risk policy, Q and V.

    Each process is swept until, over a block of ``BLOCK`` sweeps, no value moves by
    ``epsilon`` or by what double precision resolves. ``gamma`` below 1 makes that certain.
    """
    if not 0 <= gamma < 1:
        raise ValueError(f"gamma must be at least 0 and below 1, not {gamma}")
    priced = materialize(attach_reward(transitions, rewards, by))
    start = materialize(initial_values(transitions, rewards, by))
    sizes = [t.groupBy(*by).count().agg(F.max("count")).first()[0] or 0 for t in (priced, start)]
    if max(sizes) <= fold_rows:
        values = _solve_folded(priced, start, gamma, epsilon, by)
    else:
        limit = {} if broadcast_limit is None else {"limit": broadcast_limit}
        values = _solve_joined(priced, start, gamma, epsilon, by, limit)
    values = materialize(values)
    action_values = materialize(bellman_backup(priced, values, gamma, by))
    return Solution(best_action(action_values, by), action_values, values)
