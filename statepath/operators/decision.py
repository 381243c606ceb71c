"""Single steps of a decision process over the long tables P, R and V.

``by`` names extra key columns (for instance ``["model_id"]``): every table then
carries them, and one call serves many processes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.functions import portable_uniform
from statepath.storage import join_lookup


def attach_reward(transitions: DataFrame, rewards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """P with the RISK of its CLUSTER, the form the sweeps read; fails if a state has none."""
    own = rewards.select(*by, "CLUSTER", "RISK").dropDuplicates([*by, "CLUSTER"])
    joined = transitions.select(*by, "CLUSTER", "ACTION", "NEXT_CLUSTER", "prob").join(
        own, [*by, "CLUSTER"], "left"
    )
    return joined.withColumn("RISK", required("RISK", "no reward for state ", "CLUSTER"))


def required(column: str, message: str, state: str) -> Column:
    """The column, failing where it is null."""
    told = F.concat(F.lit(message), F.col(state).cast("string"))
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(told))


def initial_values(transitions: DataFrame, rewards: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """V before the first sweep: 0 where an action is known, else the state's own RISK.

    End states have no actions; ``fixed`` marks the values that never change.
    """
    acting = transitions.select(*by, "CLUSTER").distinct().withColumn("acts", F.lit(True))
    fixed = F.col("acts").isNull()
    return (
        rewards.select(*by, "CLUSTER", "RISK")
        .dropDuplicates([*by, "CLUSTER"])
        .join(acting, [*by, "CLUSTER"], "left")
        .select(*by, "CLUSTER", F.when(fixed, F.col("RISK")).otherwise(0.0).alias("v"), fixed.alias("fixed"))
    )


def bellman_backup(
    priced: DataFrame,
    values: DataFrame,
    gamma: float = 0.9,
    by: Sequence[str] = (),
    small: bool = False,
) -> DataFrame:
    """q(s, a) = R(s) + gamma * sum of prob * V(s'), from :func:`attach_reward`.

    ``small`` says that V was counted and may be broadcast. A move to a state without a
    value is an error, as leaving it out would make its action look cheap.
    """
    ahead = values.select(*by, F.col("CLUSTER").alias("NEXT_CLUSTER"), "v")
    ahead = F.broadcast(ahead) if small else ahead
    return (
        priced.join(ahead, [*by, "NEXT_CLUSTER"], "left")
        .withColumn("v", required("v", "no value for state ", "NEXT_CLUSTER"))
        .groupBy(*by, "CLUSTER", "ACTION")
        .agg((F.max("RISK") + gamma * F.sum(F.col("prob") * F.col("v"))).alias("q"))
    )


def greedy_values(action_values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return action_values.groupBy(*by, "CLUSTER").agg(F.min("q").alias("v"))


def best_action(action_values: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The action of least q per state; ties go to the lowest action."""
    order = F.struct("q", "ACTION")
    return action_values.groupBy(*by, "CLUSTER").agg(F.min_by("ACTION", order).alias("ACTION"))


def scale_values(action_values: DataFrame, mu: float = 0.75) -> DataFrame:
    return action_values.withColumn("q", F.lit(mu) * F.col("q"))


def renormalise(transitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    pair = Window.partitionBy(*by, "CLUSTER", "ACTION")
    return transitions.withColumn("prob", F.col("prob") / F.sum("prob").over(pair))


def cumulative_transitions(transitions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The interval [lo, hi) of [0, 1) that leads to each next state."""
    pair = Window.partitionBy(*by, "CLUSTER", "ACTION").orderBy("NEXT_CLUSTER")
    running = pair.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.lead("NEXT_CLUSTER").over(pair).isNull()
    upper = F.when(last, F.lit(1.0)).otherwise(F.sum("prob").over(running))
    keys = [*by, "CLUSTER", "ACTION", "NEXT_CLUSTER"]
    bounded = renormalise(transitions, by).withColumn("hi", upper)
    lower = F.coalesce(F.lag("hi").over(pair), F.lit(0.0))
    return bounded.withColumn("lo", lower).select(*keys, "lo", "hi")


def sample_transition(
    rows: DataFrame,
    intervals: DataFrame,
    seed: int | Column,
    step: Column,
    limit: int | None = None,
) -> DataFrame:
    """Draw the next state of each (ID, CLUSTER, ACTION) row, as SAMPLED; null if none."""
    options = {} if limit is None else {"limit": limit}
    drawn = rows.withColumn("u", portable_uniform(seed, F.col("ID"), step))
    table = intervals.select(
        "CLUSTER", "ACTION", F.col("NEXT_CLUSTER").alias("SAMPLED"), "lo", "hi"
    )
    within = (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))
    joined = join_lookup(
        drawn,
        table,
        ["CLUSTER", "ACTION"],
        "left",
        salt_by=["ID", "u"],
        condition=within,
        width=5,
        **options,
    )
    return joined.drop("lo", "hi")


def policy_transitions(transitions: DataFrame, policy: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of P that the policy takes."""
    chosen = policy.select(*by, "CLUSTER", "ACTION")
    return transitions.join(chosen, [*by, "CLUSTER", "ACTION"])


def terminal_states(dimension: DataFrame) -> DataFrame:
    """End-state indices, as CLUSTER."""
    return dimension.select(F.col("END_INDEX").alias("CLUSTER")).distinct()


def policy_matrix(
    transitions: DataFrame, policy: DataFrame, terminal: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """State-to-state probabilities under the policy; end states stay where they are."""
    moving = policy_transitions(transitions, policy, by).join(
        terminal, [*by, "CLUSTER"], "left_anti"
    )
    loops = terminal.select(
        *by, "CLUSTER", F.col("CLUSTER").alias("NEXT_CLUSTER"), F.lit(1.0).alias("prob")
    )
    return moving.select(*by, "CLUSTER", "NEXT_CLUSTER", "prob").unionByName(loops)


def find_absorbing(matrix: DataFrame, tol: float = 1e-12, by: Sequence[str] = ()) -> DataFrame:
    """States that keep all their mass."""
    stays = F.col("CLUSTER") == F.col("NEXT_CLUSTER")
    loop = F.coalesce(F.sum(F.when(stays, F.col("prob"))), F.lit(0.0))
    leaks = F.coalesce(F.sum(F.when(~stays, F.abs("prob"))), F.lit(0.0))
    return (
        matrix.groupBy(*by, "CLUSTER")
        .agg(loop.alias("loop"), leaks.alias("leaks"))
        .where(F.abs(F.col("loop") - 1) + F.col("leaks") <= tol)
        .select(*by, "CLUSTER")
    )


def chain_steps(first: DataFrame, second: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Matrix product of two long state-to-state tables."""
    left = first.select(*by, "CLUSTER", F.col("NEXT_CLUSTER").alias("via"), F.col("prob").alias("p"))
    right = second.select(*by, F.col("CLUSTER").alias("via"), "NEXT_CLUSTER", F.col("prob").alias("r"))
    return (
        left.join(right, [*by, "via"])
        .groupBy(*by, "CLUSTER", "NEXT_CLUSTER")
        .agg(F.sum(F.col("p") * F.col("r")).alias("prob"))
    )


def absorption_after_action(
    transitions: DataFrame, absorption: DataFrame, terminal: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """End-state probabilities of taking an action once, then the policy; all pairs at once.

    In an end state no action matters: those rows carry a null ACTION.
    """
    later = absorption.select(
        *by, F.col("CLUSTER").alias("NEXT_CLUSTER"), "END_STATE", F.col("prob").alias("later")
    )
    acting = (
        transitions.join(terminal, [*by, "CLUSTER"], "left_anti")
        .join(later, [*by, "NEXT_CLUSTER"])
        .groupBy(*by, "CLUSTER", "ACTION", "END_STATE")
        .agg(F.sum(F.col("prob") * F.col("later")).alias("prob"))
    )
    ended = terminal.select(
        *by,
        "CLUSTER",
        F.lit(None).cast("int").alias("ACTION"),
        F.col("CLUSTER").alias("END_STATE"),
        F.lit(1.0).alias("prob"),
    )
    return acting.unionByName(ended)
