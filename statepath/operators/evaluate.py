"""How well a model predicts the next risk and the end state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statepath.config import SLICE_WIDTH
from statepath.operators.ordering import join_subject, number_rows, repeated_key, time_slice
from statepath.operators.transitions import expected_next_risk, next_risk
from statepath.storage import fits_broadcast, join_lookup, materialize, spread

# The end-to-end prediction holds the (state, action) -> state table as one map
# value per task. Tables of more pairs than this are joined step by step.
LOOKUP_PAIRS = 1_000


def join_expected(steps: DataFrame, expected: DataFrame, limit: int | None = None) -> DataFrame:
    """Attach the expected next risk of its (CLUSTER, ACTION) to each step."""
    options = {} if limit is None else {"limit": limit}
    return join_lookup(steps, expected, ["CLUSTER", "ACTION"], "left", width=3, **options)


def join_subject_reward(steps: DataFrame, end_states: DataFrame) -> DataFrame:
    subjects = end_states.select(F.col("ID").cast("string").alias("ID"), "Reward")
    return join_subject(steps, subjects)


def one_step_reward_error(
    steps: DataFrame, transitions: DataFrame, rewards: DataFrame, end_states: DataFrame
) -> DataFrame:
    """MAE, MSE and R2 of the expected next risk, in one row.

    The error depends on a row only through (CLUSTER, ACTION, NEXT_RISK), so the
    steps are first counted by those, once, and only the counts meet the expectations:
    no join ever touches step rows. Steps that carry NEXT_RISK are not ordered again.
    """
    columns = ["ID", "TIME", "CLUSTER", "ACTION", "RISK"]
    labelled = "NEXT_RISK" in steps.columns
    following = steps if labelled else next_risk(steps.select(*columns), end_states)
    observed = materialize(
        following.where(F.col("NEXT_RISK").isNotNull())
        .groupBy("CLUSTER", "ACTION", F.col("NEXT_RISK").cast("double").alias("y"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    expected = expected_next_risk(transitions, rewards)
    mean = observed.agg(F.sum(F.col("n") * F.col("y")) / F.sum("n")).scalar()
    error = F.col("expected_next_risk") - F.col("y")
    known = F.when(error.isNotNull(), F.col("n"))
    rss = F.sum(F.col("n") * error * error)
    tss = F.sum(F.col("n") * F.pow(F.col("y") - F.col("mean"), F.lit(2)))
    joined = join_lookup(observed, expected, ["CLUSTER", "ACTION"], "left", salt_by=["y"], width=3)
    return joined.withColumn("mean", mean).agg(
        (F.sum(F.col("n") * F.abs(error)) / F.sum(known)).alias("mae"),
        (rss / F.sum(known)).alias("mse"),
        F.when(tss != 0, 1 - rss / tss).alias("r2"),
    )


def max_prob(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("CLUSTER", "ACTION").agg(F.max("prob").alias("max_prob"))


def join_argmax(transitions: DataFrame) -> DataFrame:
    """All next states that reach the largest probability of their (CLUSTER, ACTION)."""
    pair = Window.partitionBy("CLUSTER", "ACTION")
    best = transitions.withColumn("max_prob", F.max("prob").over(pair))
    return best.where(F.col("prob") == F.col("max_prob")).drop("max_prob")


def most_likely_transition(transitions: DataFrame) -> DataFrame:
    """The most probable next state per (CLUSTER, ACTION); ties go to the lowest."""
    rank = F.struct(F.col("prob"), -F.col("NEXT_CLUSTER"))
    return transitions.groupBy("CLUSTER", "ACTION").agg(
        F.max_by("NEXT_CLUSTER", rank).alias("most_likely_next_cluster")
    )


def subject_sequences(steps: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Ordered states and actions per (ID, BLOCK).

    A block covers ``width`` time steps, so an array has at most that many
    entries: two rows at one TIME are an error before any array is made. A subject
    shorter than that is one block, numbered 0.
    """
    ordered = F.array_sort(F.collect_list(F.struct("TIME", "CLUSTER", "ACTION")))

    def once(column: str):
        alone = (F.count(F.lit(1)) == 1) | F.col("TIME").isNull()
        return F.when(alone, F.first(column)).otherwise(repeated_key()).alias(column)

    blocks = steps.select("ID", "TIME", "CLUSTER", "ACTION", time_slice(width).alias("BLOCK"))
    return (
        spread(blocks, "ID", "BLOCK")
        .groupBy("ID", "BLOCK", "TIME")
        .agg(*[once(c) for c in ("CLUSTER", "ACTION")])
        .groupBy("ID", "BLOCK")
        .agg(ordered.alias("_rows"))
        .select(
            "ID",
            "BLOCK",
            F.col("_rows.CLUSTER").alias("cluster_seq"),
            F.col("_rows.ACTION").alias("action_seq"),
        )
    )


def most_likely_path(
    steps: DataFrame,
    transitions: DataFrame,
    width: int = SLICE_WIDTH,
    lookup_pairs: int = LOOKUP_PAIRS,
) -> DataFrame:
    """(ID, predicted_final_cluster): follow the recorded actions from the first state.

    Each action maps every state to its most likely next state (or itself), and
    such maps compose. A block of actions is therefore reduced to one map on its
    own, in parallel with the subject's other blocks; the first block only needs
    the start state. The few maps of a subject are then applied in order.
    """
    likely = materialize(most_likely_transition(transitions))
    if not fits_broadcast(likely, limit=lookup_pairs):
        return _path_by_joins(steps, likely)

    def pair(state, action):
        return state.cast("bigint") * F.lit(2**32) + action

    key = pair(F.col("CLUSTER"), F.col("ACTION"))
    entry = F.struct(key, F.col("most_likely_next_cluster"))
    table = likely.agg(F.map_from_entries(F.collect_list(entry))).scalar()
    states = likely.agg(F.collect_set("CLUSTER")).scalar()
    # the first block of a subject only needs the subject's start state
    starts = steps.groupBy("ID").agg(
        F.min_by("CLUSTER", "TIME").alias("start"), F.min(time_slice(width)).alias("BLOCK")
    )
    blocks = (
        subject_sequences(steps, width)
        .join(starts, ["ID", "BLOCK"], "left")
        .withColumn(
            "domain",
            F.when(F.col("start").isNotNull(), F.array("start")).otherwise(states),
        )
        .withColumn("table", table)
    )

    def step(state, action):
        return F.coalesce(F.try_element_at(F.col("table"), pair(state, action)), state)

    image = F.aggregate(
        "action_seq",
        F.col("domain"),
        lambda at, action: F.transform(at, lambda state: step(state, action)),
    )
    maps = (
        blocks.select("ID", F.struct("BLOCK", "domain", image.alias("image")).alias("map"))
        .groupBy("ID")
        .agg(F.array_sort(F.collect_list("map")).alias("maps"))
    )

    def apply(state, block):
        # states outside the domain have no outgoing entry and stay
        position = F.nullif(F.array_position(block["domain"], state), F.lit(0)).cast("int")
        return F.coalesce(F.try_element_at(block["image"], position), state)

    begin = F.element_at(F.element_at("maps", 1)["domain"], 1)
    final = F.aggregate("maps", begin, apply)
    return maps.select("ID", final.alias("predicted_final_cluster"))


def _path_by_joins(steps: DataFrame, likely: DataFrame) -> DataFrame:
    """The same prediction, one job per step, for tables too large to hold in a value."""
    sliced = steps.select("ID", "TIME", "CLUSTER", "ACTION", time_slice().alias("_slice"))
    ordered = materialize(number_rows(sliced, key="ID", slice_by="_slice", order_by=["TIME"]))
    state = ordered.where("position = 0").select("ID", "CLUSTER")
    longest = ordered.agg(F.max("position")).first()[0]
    for position in range(0 if longest is None else longest + 1):
        action = ordered.where(F.col("position") == position).select("ID", "ACTION")
        moved = join_lookup(
            state.join(action, "ID", "left"),
            likely,
            ["CLUSTER", "ACTION"],
            "left",
            salt_by=["ID"],
            width=3,
        )
        new = F.coalesce("most_likely_next_cluster", "CLUSTER")
        state = materialize(moved.select("ID", new.alias("CLUSTER")))
    return state.withColumnRenamed("CLUSTER", "predicted_final_cluster")


def join_truth(predicted: DataFrame, indexed: DataFrame) -> DataFrame:
    """Attach the true END_INDEX and whether the prediction equals it."""
    truth = indexed.select("ID", "END_INDEX")
    return predicted.join(truth, "ID", "left").withColumn(
        "correct", F.col("predicted_final_cluster") == F.col("END_INDEX")
    )


def path_accuracy(judged: DataFrame) -> DataFrame:
    return judged.agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))


def confusion_matrix(judged: DataFrame) -> DataFrame:
    keys = ["predicted_final_cluster", "END_INDEX"]
    return judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).orderBy(*keys)
