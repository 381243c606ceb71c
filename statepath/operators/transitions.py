"""From steps and end states to the transition table P and reward table R."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.config import SLICE_WIDTH
from statepath.operators.ordering import join_subject, lead_values, needs_slices
from statepath.storage import join_lookup

TRANSITION_KEYS = ("CLUSTER", "ACTION", "NEXT_CLUSTER")


def max_state(steps: DataFrame) -> DataFrame:
    """The highest real state; end states are numbered after it."""
    return steps.agg(F.max("CLUSTER").alias("max_cluster"))


def end_state_names(end_states: DataFrame) -> DataFrame:
    """One row per end-state name and its Reward; fails if a name has two."""
    names = end_states.groupBy("end_state").agg(
        F.min("Reward").alias("Reward"), F.max("Reward").alias("_other")
    )
    message = F.concat(F.lit("two Rewards for end state "), F.col("end_state"))
    checked = F.when(F.col("Reward").eqNullSafe(F.col("_other")), F.col("Reward")).otherwise(
        F.raise_error(message)
    )
    return names.select("end_state", checked.alias("Reward"))


def end_state_dimension(end_states: DataFrame, offset: int | Column) -> DataFrame:
    """(end_state, Reward, END_INDEX): names numbered alphabetically from ``offset``.

    Only the distinct names are ranked, never the subjects.
    """
    start = F.lit(offset) if isinstance(offset, int) else offset
    rank = F.dense_rank().over(Window.orderBy("end_state"))
    return end_state_names(end_states).select(
        "end_state", "Reward", (rank - 1 + start).cast("int").alias("END_INDEX")
    )


def state_offset(steps: DataFrame) -> Column:
    """First end-state index of a step table, as a scalar subquery."""
    return max_state(steps).select(F.col("max_cluster") + 1).scalar()


def step_bounds(steps: DataFrame, width: int = SLICE_WIDTH) -> tuple[int, bool]:
    """First end-state index, and whether some subject outgrows one time slice."""
    top, latest = steps.agg(F.max("CLUSTER"), F.max("TIME")).first()
    return (0 if top is None else top + 1), latest is not None and latest >= width


def _once(column: str) -> Column:
    """The column, failing where its subject has more than one row."""
    message = F.concat(F.lit("two end states for subject "), F.col("ID"))
    single = F.col("_rows") == 1
    return F.when(single, F.col(column)).otherwise(F.raise_error(message)).alias(column)


def unique_subjects(end_states: DataFrame) -> DataFrame:
    """(ID, Reward), one row per subject; fails on a second row."""
    subjects = end_states.groupBy(F.col("ID").cast("string").alias("ID")).agg(
        F.min("Reward").alias("Reward"), F.count(F.lit(1)).alias("_rows")
    )
    return subjects.select("ID", _once("Reward"))


def index_end_states(end_states: DataFrame, offset: int | Column) -> DataFrame:
    """(ID, end_state, Reward, END_INDEX), one row per subject; fails on a second row."""
    names = end_state_dimension(end_states, offset).select("end_state", "END_INDEX")
    # integers aggregate by hash; the name only costs a sort where it is asked for
    subjects = (
        join_lookup(end_states, names, ["end_state"], "left", salt_by=["ID"])
        .groupBy(F.col("ID").cast("string").alias("ID"))
        .agg(
            F.min("end_state").alias("end_state"),
            F.min("Reward").alias("Reward"),
            F.min("END_INDEX").alias("END_INDEX"),
            F.count(F.lit(1)).alias("_rows"),
        )
    )
    return subjects.select("ID", _once("end_state"), _once("Reward"), _once("END_INDEX"))


def join_end_state(steps: DataFrame, subjects: DataFrame) -> DataFrame:
    """Attach END_INDEX of the subject to each of its steps."""
    return join_subject(steps, subjects.select("ID", "END_INDEX"))


def next_state(
    steps: DataFrame,
    end_states: DataFrame,
    width: int = SLICE_WIDTH,
    bounds: tuple[int, bool] | None = None,
) -> DataFrame:
    """Add NEXT_CLUSTER: the next observed row's state, else the subject's end state.

    ``bounds`` are the results of :func:`step_bounds` where they are known already.
    """
    offset, sliced = bounds or step_bounds(steps, width)
    return lead_values(
        steps,
        {"NEXT_CLUSTER": "CLUSTER"},
        index_end_states(end_states, offset),
        {"NEXT_CLUSTER": "END_INDEX"},
        sliced,
        width,
    )


def next_risk(steps: DataFrame, end_states: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Add NEXT_RISK: the next observed row's RISK, else the subject's Reward."""
    return lead_values(
        steps,
        {"NEXT_RISK": "RISK"},
        unique_subjects(end_states),
        {"NEXT_RISK": "Reward"},
        needs_slices(steps, width),
        width,
    )


def next_state_and_risk(
    steps: DataFrame,
    end_states: DataFrame,
    width: int = SLICE_WIDTH,
    bounds: tuple[int, bool] | None = None,
) -> DataFrame:
    """NEXT_CLUSTER and NEXT_RISK from one pass over the ordered steps."""
    offset, sliced = bounds or step_bounds(steps, width)
    return lead_values(
        steps,
        {"NEXT_CLUSTER": "CLUSTER", "NEXT_RISK": "RISK"},
        index_end_states(end_states, offset),
        {"NEXT_CLUSTER": "END_INDEX", "NEXT_RISK": "Reward"},
        sliced,
        width,
    )


def transition_counts(steps: DataFrame) -> DataFrame:
    """Rows per (CLUSTER, ACTION, NEXT_CLUSTER) with a known next state."""
    known = steps.where(F.col("NEXT_CLUSTER").isNotNull())
    return known.groupBy(*TRANSITION_KEYS).agg(F.count(F.lit(1)).alias("cnt"))


def join_totals(counts: DataFrame) -> DataFrame:
    """Attach the (CLUSTER, ACTION) total to each count."""
    pair = Window.partitionBy("CLUSTER", "ACTION")
    return counts.withColumn("total", F.sum("cnt").over(pair))


def transition_probabilities(steps: DataFrame) -> DataFrame:
    """The transition table P in long form."""
    return join_totals(transition_counts(steps)).select(
        *TRANSITION_KEYS, (F.col("cnt") / F.col("total")).alias("prob")
    )


def state_rewards(steps: DataFrame) -> DataFrame:
    return steps.groupBy("CLUSTER").agg(F.avg("RISK").alias("RISK"))


def end_state_rewards(dimension: DataFrame) -> DataFrame:
    """(CLUSTER, RISK) of the end states, from their dimension."""
    return dimension.select(
        F.col("END_INDEX").alias("CLUSTER"), F.col("Reward").cast("double").alias("RISK")
    ).distinct()


def reward_table(steps: DataFrame, end_states: DataFrame) -> DataFrame:
    """The reward table R: mean RISK of real states, Reward of end states."""
    dimension = end_state_dimension(end_states, state_offset(steps))
    return union_by_name(state_rewards(steps), end_state_rewards(dimension))


def dedupe_rewards(rewards: DataFrame) -> DataFrame:
    return rewards.select("CLUSTER", "RISK").dropDuplicates()


def join_next_reward(transitions: DataFrame, rewards: DataFrame) -> DataFrame:
    """Attach the RISK of the next state to each transition."""
    risk = rewards.select(F.col("CLUSTER").alias("NEXT_CLUSTER"), F.col("RISK"))
    return transitions.join(risk, "NEXT_CLUSTER", "left")


def expected_next_risk(transitions: DataFrame, rewards: DataFrame) -> DataFrame:
    """Expected RISK of the next state per (CLUSTER, ACTION)."""
    weighted = F.sum(F.col("prob") * F.col("RISK"))
    return (
        join_next_reward(transitions, rewards)
        .groupBy("CLUSTER", "ACTION")
        .agg(weighted.alias("expected_next_risk"))
    )


def cluster_sizes(steps: DataFrame, key: str = "CLUSTER") -> DataFrame:
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_states(steps: DataFrame, column: str = "NEXT_CLUSTER") -> DataFrame:
    return steps.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def state_action_support(steps: DataFrame, min_obs: int = 0) -> DataFrame:
    """Labelled rows per (CLUSTER, ACTION), where at least ``min_obs``."""
    known = steps.where(F.col("NEXT_CLUSTER").isNotNull())
    counts = known.groupBy("CLUSTER", "ACTION").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.where(F.col("cnt") >= min_obs)


def union_by_name(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.unionByName(second, allowMissingColumns=True)


def order_series(transitions: DataFrame) -> DataFrame:
    return transitions.orderBy("ACTION", "CLUSTER", "NEXT_CLUSTER")
