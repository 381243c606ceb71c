"""Every operator as a query over the driver's tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statepath.config import Config
from statepath.functions import (
    js_divergence,
    kl_divergence,
    pack_array,
    portable_uniform,
    vector_element,
)
from statepath.operators import (
    decision,
    evaluate,
    forest,
    incoherence,
    ordering,
    prepare,
    profile,
    quality,
    transitions,
)
from statepath.plans.absorb import absorption_probabilities
from statepath.plans.refine import apply_split, prepare_steps, refine_states
from statepath.plans.rollout import policy_rollout
from statepath.plans.solve import run_sweeps, solve_policy
from statepath.sources import (
    Model,
    event_end_states,
    event_steps,
    order_steps,
    read_model,
    read_table,
    scan_end_states,
    scan_steps,
    write_model,
)
from statepath.sources.driver_tables import order_end_states
from statepath.storage import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]

ACTIONS = [0, 1, 2, 3, 4]
FEATURES = ["k", "value", "total_sofa"]
MIN_OBS = 200
MIN_SPLITOFF = 30
VECTOR_SIZE = 3
CONFIG = Config(min_obs=MIN_OBS, min_splitoff=MIN_SPLITOFF)

REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; ``_query`` only avoids hiding an import."""
    REGISTRY[fn.__name__.removesuffix("_query")] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- shared inputs


def given_states(steps: DataFrame) -> DataFrame:
    """States given on input, by RISK, as a user with known states would supply them."""
    state = F.when(F.col("RISK") < 2, 0).when(F.col("RISK") < 4, 1).otherwise(2)
    return steps.withColumn("CLUSTER", state.cast("int"))


def base_steps(spark: SparkSession, sf: str) -> DataFrame:
    return given_states(prepare_steps(event_steps(spark, sf), CONFIG))


def written_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Prepared steps and end states as tables, for queries that read them repeatedly."""
    return materialize(base_steps(spark, sf)), materialize(event_end_states(spark, sf))


def labelled_steps(spark: SparkSession, sf: str) -> DataFrame:
    return transitions.next_state(*written_inputs(spark, sf))


def model_of(steps: DataFrame, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P and R, written once, as every later consumer of a model reads them."""
    p = transitions.transition_probabilities(transitions.next_state(steps, ends))
    return materialize(p), materialize(transitions.reward_table(steps, ends))


def model_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return model_of(*written_inputs(spark, sf))


def dimension_of(steps: DataFrame, ends: DataFrame) -> DataFrame:
    return transitions.end_state_dimension(ends, transitions.state_offset(steps))


def end_dimension(spark: SparkSession, sf: str) -> DataFrame:
    return dimension_of(base_steps(spark, sf), event_end_states(spark, sf))


def terminal(spark: SparkSession, sf: str) -> DataFrame:
    return decision.terminal_states(end_dimension(spark, sf))


def indexed_of(steps: DataFrame, ends: DataFrame) -> DataFrame:
    return transitions.index_end_states(ends, transitions.state_offset(steps))


def indexed_ends(spark: SparkSession, sf: str) -> DataFrame:
    return indexed_of(*written_inputs(spark, sf))


def vector_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with a normalised feature vector in place of a forest's output."""
    steps = labelled_steps(spark, sf)
    total = F.col("k") + F.col("value") + F.col("total_sofa") + 3
    parts = [(F.col(c) + 1) / total for c in FEATURES]
    return steps.withColumn("prob", F.array(*parts))


def halved_rows(spark: SparkSession, sf: str) -> DataFrame:
    """State 1 with a given SUB, in place of the outcome of a split."""
    rows = vector_rows(spark, sf).where("CLUSTER = 1")
    return rows.withColumn("SUB", (F.col("k") >= 50).cast("int"))


def solved_matrix(spark: SparkSession, sf: str):
    steps, ends = written_inputs(spark, sf)
    p, r = model_of(steps, ends)
    absorbing = materialize(decision.terminal_states(dimension_of(steps, ends)))
    policy = solve_policy(p, r, CONFIG.gamma, CONFIG.epsilon).policy
    return p, absorbing, decision.policy_matrix(p, policy, absorbing)


def spoiled_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps with null subjects, negative times, null and NaN features."""
    nan = F.lit(float("nan"))
    return event_steps(spark, sf).withColumns(
        {
            "ID": F.when(F.col("k") % 10 != 0, F.col("ID")),
            "TIME": F.col("TIME") - 5,
            "k": F.when(F.col("k") % 7 != 0, F.col("k")),
            "value": F.when(F.col("value") < 5, nan).otherwise(F.col("value")),
        }
    )


# ---------------------------------------------------------------- sources, sinks


@query
def scan_steps_query(spark, sf):
    event_steps(spark, sf).createOrReplaceTempView("statepath_steps")
    return scan_steps(spark, "statepath_steps")


@query
def scan_end_states_query(spark, sf):
    event_end_states(spark, sf).createOrReplaceTempView("statepath_end_states")
    return scan_end_states(spark, "statepath_end_states")


@query
def scan_named(spark, sf):
    order_steps(spark, sf).createOrReplaceTempView("statepath_orders")
    return read_table(spark, "statepath_orders")


def stored_model(spark: SparkSession, sf: str) -> Model:
    base, ends = written_inputs(spark, sf)
    steps = materialize(transitions.next_state(base, ends))
    rewards = transitions.reward_table(steps, ends)
    path = new_path(spark)
    write_model(Model(steps, transitions.transition_probabilities(steps), rewards), path)
    return read_model(spark, path)


@query
def scan_model(spark, sf):
    model = stored_model(spark, sf)
    joined = transitions.join_next_reward(model.transitions, model.rewards)
    return rounded(joined, "prob", "RISK")


@query
def sink_model(spark, sf):
    """All rows of the written tables; ``value`` is the RISK, the prob or the mean RISK."""
    model = stored_model(spark, sf)
    values = {"steps": "RISK", "transitions": "prob", "rewards": "RISK"}
    written = None
    for name, table in model._asdict().items():
        value = F.round(F.col(values[name]).cast("double"), 6).alias("value")
        keys = [c for c in ("ID", "TIME", "CLUSTER", "ACTION", "NEXT_CLUSTER") if c in table.columns]
        rows = table.select(F.lit(name).alias("name"), *keys, value)
        written = rows if written is None else written.unionByName(rows, allowMissingColumns=True)
    return written


# ---------------------------------------------------------------- preparation


@query
def clean_steps(spark, sf):
    return prepare.clean_steps(spoiled_steps(spark, sf).select("ID", "TIME", "ACTION", "RISK"))


@query
def cast_keys(spark, sf):
    steps = base_steps(spark, sf).withColumns(
        {"ID": F.col("ID").cast("bigint"), "CLUSTER": F.col("CLUSTER").cast("double")}
    )
    return prepare.cast_keys(steps).select("ID", "TIME", "ACTION", "CLUSTER")


@query
def combine_risk(spark, sf):
    return prepare.combine_risk(event_steps(spark, sf)).select("ID", "TIME", "RISK")


@query
def infer_features(spark, sf):
    steps = labelled_steps(spark, sf)
    return steps.select("ID", "TIME", *prepare.infer_features(steps))


@query
def select_existing(spark, sf):
    wanted = prepare.output_columns(["value", "not_there", "k"])
    return prepare.select_existing(base_steps(spark, sf), wanted)


@query
def drop_working(spark, sf):
    rows = vector_rows(spark, sf).withColumn("SUB", (F.col("k") >= 50).cast("int"))
    return prepare.drop_working(rows, ["prob", "SUB"])


@query
def rename_features(spark, sf):
    return prepare.rename_features(event_steps(spark, sf)).select("ID", "TIME", "Total SOFA")


@query
def missing_features(spark, sf):
    return prepare.missing_features(prepare.rename_features(event_steps(spark, sf)))


@query
def skip_invalid(spark, sf):
    return prepare.skip_invalid(spoiled_steps(spark, sf), ["k", "value"])


@query
def count_invalid(spark, sf):
    return prepare.count_invalid(spoiled_steps(spark, sf), ["k", "value"])


@query
def labelled_only(spark, sf):
    """All steps, and again as those of subjects without an end state."""
    base, ends = written_inputs(spark, sf)
    endless = base.withColumn("ID", F.concat(F.lit("x"), "ID"))
    steps = transitions.next_state(materialize(base.unionByName(endless)), ends)
    return prepare.labelled_only(steps).select("ID", "TIME", "NEXT_CLUSTER")


@query
def state_action_slice(spark, sf):
    return prepare.state_action_slice(base_steps(spark, sf), 1, 2)


@query
def state_other_actions(spark, sf):
    return prepare.state_other_actions(base_steps(spark, sf), 1, 2)


@query
def state_rest(spark, sf):
    return prepare.state_rest(base_steps(spark, sf), 1)


@query
def start_states(spark, sf):
    return prepare.start_states(base_steps(spark, sf))


@query
def conditional_relabel(spark, sf):
    return prepare.conditional_relabel(halved_rows(spark, sf), 3).select("ID", "TIME", "CLUSTER")


@query
def fill_terminal(spark, sf):
    steps, ends = written_inputs(spark, sf)
    rows = ordering.lead_values(steps, {"NEXT_RISK": "RISK"})
    joined = evaluate.join_subject_reward(rows, ends)
    return prepare.fill_terminal(joined, "NEXT_RISK", "Reward").select("ID", "TIME", "NEXT_RISK")


@query
def name_end_states(spark, sf):
    steps, ends = written_inputs(spark, sf)
    dimension = dimension_of(steps, ends).where("end_state <> 'FURNITURE'")
    labels = dimension.select(F.col("END_INDEX").alias("END_STATE"), F.col("end_state").alias("label"))
    indexed = indexed_of(steps, ends).select("ID", F.col("END_INDEX").alias("END_STATE"))
    return prepare.name_end_states(indexed, labels)


# ---------------------------------------------------------------- joins


@query
def join_end_state(spark, sf):
    steps, ends = written_inputs(spark, sf)
    joined = transitions.join_end_state(steps, indexed_of(steps, ends))
    return joined.select("ID", "TIME", "CLUSTER", "END_INDEX")


@query
def join_totals(spark, sf):
    return transitions.join_totals(transitions.transition_counts(labelled_steps(spark, sf)))


@query
def join_next_reward(spark, sf):
    return rounded(transitions.join_next_reward(*model_tables(spark, sf)), "prob", "RISK")


@query
def join_expected(spark, sf):
    steps, ends = written_inputs(spark, sf)
    expected = transitions.expected_next_risk(*model_of(steps, ends))
    joined = evaluate.join_expected(steps, expected)
    return rounded(
        joined.select("ID", "TIME", "CLUSTER", "ACTION", "expected_next_risk"),
        "expected_next_risk",
    )


@query
def join_subject_reward(spark, sf):
    joined = evaluate.join_subject_reward(*written_inputs(spark, sf))
    return joined.select("ID", "TIME", "RISK", "Reward")


@query
def join_argmax(spark, sf):
    return rounded(evaluate.join_argmax(model_tables(spark, sf)[0]), "prob")


@query
def join_truth(spark, sf):
    steps, ends = written_inputs(spark, sf)
    predicted = evaluate.most_likely_path(steps, model_of(steps, ends)[0])
    return evaluate.join_truth(predicted, indexed_of(steps, ends))


@query
def policy_transitions(spark, sf):
    p, r = model_tables(spark, sf)
    return rounded(decision.policy_transitions(p, solve_policy(p, r, CONFIG.gamma, CONFIG.epsilon).policy), "prob")


# ---------------------------------------------------------------- aggregations


@query
def cluster_sizes(spark, sf):
    return transitions.cluster_sizes(base_steps(spark, sf))


@query
def distinct_states(spark, sf):
    return transitions.distinct_states(labelled_steps(spark, sf))


@query
def transition_counts(spark, sf):
    return transitions.transition_counts(labelled_steps(spark, sf))


@query
def transition_probabilities(spark, sf):
    return rounded(transitions.transition_probabilities(labelled_steps(spark, sf)), "prob")


@query
def transition_probabilities_orders(spark, sf):
    steps = given_states(prepare.cast_keys(prepare.clean_steps(order_steps(spark, sf))))
    labelled = transitions.next_state(materialize(steps), order_end_states(spark, sf))
    return rounded(transitions.transition_probabilities(labelled), "prob")


@query
def state_rewards(spark, sf):
    return rounded(transitions.state_rewards(base_steps(spark, sf)), "RISK")


@query
def end_state_rewards(spark, sf):
    return transitions.end_state_rewards(end_dimension(spark, sf))


@query
def reward_table(spark, sf):
    rewards = transitions.reward_table(*written_inputs(spark, sf))
    return rounded(rewards, "RISK")


@query
def expected_next_risk(spark, sf):
    expected = transitions.expected_next_risk(*model_tables(spark, sf))
    return rounded(expected, "expected_next_risk")


@query
def one_step_reward_error(spark, sf):
    steps, ends = written_inputs(spark, sf)
    error = evaluate.one_step_reward_error(steps, *model_of(steps, ends), ends)
    return rounded(error, "mae", "mse", "r2")


@query
def stddev_incoherence(spark, sf):
    return rounded(
        incoherence.stddev_incoherence(labelled_steps(spark, sf), MIN_OBS), "incoherence"
    )


@query
def mean_distribution(spark, sf):
    means = incoherence.mean_distribution(vector_rows(spark, sf), VECTOR_SIZE)
    parts = [F.round(F.col("mean")[i], 6).alias(f"mean_{i}") for i in range(VECTOR_SIZE)]
    return means.select("CLUSTER", "ACTION", *parts)


@query
def information_radius(spark, sf):
    return rounded(
        incoherence.information_radius(vector_rows(spark, sf), VECTOR_SIZE), "incoherence"
    )


@query
def max_state(spark, sf):
    return transitions.max_state(base_steps(spark, sf))


@query
def max_prob(spark, sf):
    return rounded(evaluate.max_prob(model_tables(spark, sf)[0]), "max_prob")


@query
def subject_sequences(spark, sf):
    """Sequences as text, in blocks of 32 steps."""
    blocks = evaluate.subject_sequences(base_steps(spark, sf), width=32)
    text = {
        c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("cluster_seq", "action_seq")
    }
    return blocks.withColumns(text)


@query
def path_accuracy(spark, sf):
    return rounded(evaluate.path_accuracy(join_truth(spark, sf)), "accuracy")


@query
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(join_truth(spark, sf))


@query
def dedupe_rewards(spark, sf):
    rewards = transitions.reward_table(*written_inputs(spark, sf))
    return rounded(transitions.dedupe_rewards(rewards.unionByName(rewards)), "RISK")


@query
def time_profile(spark, sf):
    return rounded(
        profile.time_profile(base_steps(spark, sf)), "mean", "std", "p25", "p50", "p75"
    )


@query
def time_histogram(spark, sf):
    return profile.time_histogram(base_steps(spark, sf))


@query
def action_frequency(spark, sf):
    return rounded(profile.action_frequency(base_steps(spark, sf)), "freq")


@query
def action_frequency_by_state(spark, sf):
    freq = profile.action_frequency_by_state(base_steps(spark, sf), [*ACTIONS, 5])
    return rounded(freq, "freq")


@query
def feature_zscores(spark, sf):
    return rounded(profile.feature_zscores(base_steps(spark, sf), FEATURES), "zscore")


@query
def state_action_support(spark, sf):
    return transitions.state_action_support(labelled_steps(spark, sf), 2 * MIN_OBS)


# ---------------------------------------------------------------- windows, top-k


@query
def next_state(spark, sf):
    return labelled_steps(spark, sf)


@query
def next_risk(spark, sf):
    steps = transitions.next_risk(*written_inputs(spark, sf))
    return steps.select("ID", "TIME", "RISK", "NEXT_RISK")


@query
def index_end_states(spark, sf):
    return indexed_ends(spark, sf)


@query
def rank_incoherence(spark, sf):
    radius = incoherence.information_radius(vector_rows(spark, sf), VECTOR_SIZE)
    left = incoherence.rank_incoherence(radius, MIN_OBS, [(0, 1), (2, 3)])
    return rounded(left.limit(1), "incoherence")


@query
def worst_action(spark, sf):
    return rounded(incoherence.worst_action(halved_rows(spark, sf), VECTOR_SIZE), "incoherence")


@query
def best_action(spark, sf):
    p, r = model_tables(spark, sf)
    return decision.best_action(swept_action_values(p, r, 2))


@query
def order_trajectories(spark, sf):
    return base_steps(spark, sf).select("ID", "TIME", "CLUSTER", "ACTION").orderBy("ID", "TIME")


@query
def order_series(spark, sf):
    return rounded(transitions.order_series(model_tables(spark, sf)[0]), "prob")


# ---------------------------------------------------------------- set operations


@query
def union_by_name(spark, sf):
    halves = halved_rows(spark, sf).drop("prob")
    rest = prepare.state_rest(labelled_steps(spark, sf), 1)
    return transitions.union_by_name(rest, halves).select("ID", "TIME", "CLUSTER", "SUB")


@query
def distinct_rows(spark, sf):
    return labelled_steps(spark, sf).select("CLUSTER", "ACTION", "NEXT_CLUSTER").distinct()


# ---------------------------------------------------------------- functions


def with_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(vector_rows(spark, sf))
    means = incoherence.mean_distribution(rows, VECTOR_SIZE)
    joined = evaluate.join_lookup(rows, means, ["CLUSTER", "ACTION"], width=VECTOR_SIZE)
    return joined.select("ID", "TIME", "prob", "mean")


@query
def kl_divergence_query(spark, sf):
    value = kl_divergence(F.col("prob"), F.col("mean"))
    return with_mean(spark, sf).select("ID", "TIME", F.round(value, 6).alias("kl"))


@query
def js_divergence_query(spark, sf):
    value = js_divergence(F.col("prob"), F.col("mean"))
    return with_mean(spark, sf).select("ID", "TIME", F.round(value, 6).alias("js"))


@query
def vector_element_query(spark, sf):
    rows = base_steps(spark, sf).withColumn("v", pack_array(FEATURES))
    return rows.select(
        "ID",
        "TIME",
        vector_element(F.col("v"), 1).alias("present"),
        vector_element(F.col("v"), 7).alias("absent"),
        vector_element(F.col("v"), F.col("total_sofa")).alias("chosen"),
    )


@query
def pack_array_query(spark, sf):
    packed = F.array_join(pack_array(["k", "total_sofa"]).cast("array<int>").cast("array<string>"), ",")
    return base_steps(spark, sf).select("ID", "TIME", packed.alias("packed"))


@query
def math(spark, sf):
    return base_steps(spark, sf).select(
        "ID",
        "TIME",
        F.round(F.abs(F.col("value") - F.col("k")), 6).alias("distance"),
        F.round(F.pow(F.col("value") - F.col("k"), F.lit(2)), 4).alias("squared"),
        F.round(F.col("RISK") / (F.col("k") + 1), 6).alias("ratio"),
        F.round(F.ln(F.col("value") + 1), 6).alias("log"),
    )


@query
def portable_uniform_query(spark, sf):
    u = portable_uniform(42, F.col("ID"), F.col("TIME"))
    return base_steps(spark, sf).select("ID", "TIME", F.round(u, 9).alias("u"))


@query
def renormalise(spark, sf):
    """P with weights that no longer sum to 1."""
    p = model_tables(spark, sf)[0].withColumn("prob", F.col("prob") * (F.col("NEXT_CLUSTER") + 1))
    return rounded(decision.renormalise(p), "prob")


@query
def expand_grid(spark, sf):
    counts = transitions.state_action_support(labelled_steps(spark, sf), 2 * MIN_OBS)
    return profile.expand_grid(counts, "CLUSTER", ACTIONS, "ACTION")


@query
def wide_matrix(spark, sf):
    p = model_tables(spark, sf)[0]
    wide = profile.wide_matrix(p, "CLUSTER", "NEXT_CLUSTER", "prob", range(8), "to_")
    return rounded(wide, *[f"to_{i}" for i in range(8)])


# ---------------------------------------------------------------- learning


@query
def assemble(spark, sf):
    rows = forest.assemble(spoiled_steps(spark, sf), ["k", "value"])
    entries = forest.vector_to_array("features")
    return rows.select(
        "ID", "TIME", entries[0].alias("first"), entries[1].alias("second")
    )


@query
def initial_states_events(spark, sf):
    steps = prepare_steps(event_steps(spark, sf), CONFIG)
    return forest.initial_states(steps, 3).select("ID", "TIME", "RISK", "CLUSTER")


def fitted(spark: SparkSession, sf: str):
    steps = materialize(labelled_steps(spark, sf))
    return steps, forest.next_state_classifier(steps, FEATURES, 20, 5)


@query
def next_state_classifier_events(spark, sf):
    steps, model = fitted(spark, sf)
    return forest.forest_predict(model, steps).select("ID", "TIME", "prediction")


@query
def next_state_distribution_events(spark, sf):
    steps, model = fitted(spark, sf)
    return forest.next_state_distribution(model, steps).select("ID", "TIME", "prob")


def split_rows(spark: SparkSession, sf: str):
    rows = materialize(vector_rows(spark, sf).where("CLUSTER = 1"))
    chosen = (F.col("ACTION") == 2) & F.col("NEXT_CLUSTER").isNotNull()
    return forest.split_state(rows.where(chosen), VECTOR_SIZE), rows.where(~chosen)


@query
def split_state_events(spark, sf):
    return split_rows(spark, sf)[0].select("ID", "TIME", "NEXT_CLUSTER", "SUB")


@query
def extend_split_events(spark, sf):
    halves, others = split_rows(spark, sf)
    extended = forest.extend_split(halves, others, FEATURES, VECTOR_SIZE)
    return extended.select("ID", "TIME", "ACTION", "SUB")


@query
def accept_split(spark, sf):
    return forest.accept_split(halved_rows(spark, sf), MIN_SPLITOFF)


@query
def apply_split_query(spark, sf):
    base, ends = written_inputs(spark, sf)
    steps = materialize(transitions.next_state(base, ends))
    halves = steps.where("CLUSTER = 1").withColumn("SUB", (F.col("k") >= 50).cast("int"))
    split = apply_split(steps, halves, 1, 3, ends)
    return split.select("ID", "TIME", "CLUSTER", "NEXT_CLUSTER")


@query
def refine_states_events(spark, sf):
    trained = refine_states(event_steps(spark, sf), event_end_states(spark, sf), CONFIG)
    return trained.log


def wrapped_forest(spark: SparkSession, sf: str):
    rows = materialize(spoiled_steps(spark, sf))
    return rows, forest.forest_fit(rows, ["k", "value", "total_sofa"], "ACTION", 20, 5)


@query
def forest_fit_events(spark, sf):
    """Rows predicted per class by a fitted forest."""
    rows, model = wrapped_forest(spark, sf)
    return forest.forest_predict(model, rows).groupBy("prediction").agg(F.count("*").alias("cnt"))


@query
def forest_predict_events(spark, sf):
    rows, model = wrapped_forest(spark, sf)
    return forest.forest_predict(model, rows).select("ID", "TIME", "prediction")


@query
def forest_predict_proba_events(spark, sf):
    rows, model = wrapped_forest(spark, sf)
    return forest.forest_predict_proba(model, rows).select("ID", "TIME", "prob")


@query
def surrogate_tree_events(spark, sf):
    steps = materialize(base_steps(spark, sf))
    model = forest.surrogate_tree(steps, FEATURES)
    predicted = forest.forest_predict(model, steps)
    return predicted.groupBy("CLUSTER", "prediction").agg(F.count("*").alias("cnt"))


@query
def grid_search_events(spark, sf):
    return forest.grid_search(materialize(base_steps(spark, sf)), FEATURES)[1]


@query
def tree_rules_events(spark, sf):
    steps = materialize(base_steps(spark, sf))
    return forest.tree_rules(forest.surrogate_tree(steps, FEATURES), steps)


# Learning queries whose answer is forced: what is to be learned is a function of a
# feature with four values, so SQL can state it.


def sofa_steps(spark: SparkSession, sf: str) -> DataFrame:
    """All steps, every seventh without total_sofa."""
    known = F.when(F.col("k") % 7 != 0, F.col("total_sofa"))
    return materialize(event_steps(spark, sf).withColumns({"total_sofa": known, "CLASS": known}))


@query
def initial_states(spark, sf):
    """Rows, states, and whether states are ordered and apart in RISK."""
    steps = prepare_steps(event_steps(spark, sf), CONFIG)
    ranges = forest.initial_states(steps, 3).groupBy("CLUSTER").agg(
        F.count(F.lit(1)).alias("n"), F.min("RISK").alias("low"), F.max("RISK").alias("high")
    )
    listed = F.array_sort(F.collect_list(F.struct("CLUSTER", "low", "high")))
    places = F.sequence(F.lit(0), F.size("states") - 2)
    apart = F.forall(
        places, lambda i: F.get("states", i)["high"] < F.get("states", i + 1)["low"]
    )
    return ranges.agg(F.sum("n").alias("n_rows"), listed.alias("states")).select(
        "n_rows", F.size("states").alias("n_states"), apart.alias("ordered")
    )


@query
def next_state_classifier(spark, sf):
    steps = sofa_steps(spark, sf).withColumn("NEXT_CLUSTER", F.col("CLASS"))
    model = forest.next_state_classifier(steps, ["total_sofa"], 20, 5)
    return forest.forest_predict(model, steps).select("ID", "TIME", "prediction")


@query
def next_state_distribution(spark, sf):
    """For each row the number of entries and whether they sum to 1; null if it has none."""
    steps = labelled_steps(spark, sf).withColumn("k", F.when(F.col("k") % 7 != 0, F.col("k")))
    steps = materialize(steps)
    model = forest.next_state_classifier(steps, FEATURES, 20, 5)
    total = F.aggregate("prob", F.lit(0.0), lambda acc, p: acc + p)
    return forest.next_state_distribution(model, steps).select(
        "ID", "TIME", F.nullif(F.size("prob"), F.lit(-1)).alias("n_entries"),
        (F.abs(total - 1) < 1e-9).alias("is_whole"),
    )


def separable_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All steps; those of high total_sofa lead elsewhere, with other probabilities."""
    high = F.col("total_sofa") >= 2
    return materialize(
        base_steps(spark, sf).withColumns(
            {
                "NEXT_CLUSTER": F.when(high, 1).otherwise(0),
                "prob": F.when(high, F.array(F.lit(0.0), F.lit(1.0))).otherwise(
                    F.array(F.lit(1.0), F.lit(0.0))
                ),
            }
        )
    )


@query
def split_state(spark, sf):
    return forest.split_state(separable_rows(spark, sf), 2).select("ID", "TIME", "SUB")


@query
def extend_split(spark, sf):
    rows = separable_rows(spark, sf)
    halves = forest.split_state(rows.where("ACTION = 2"), 2)
    extended = forest.extend_split(halves, rows.where("ACTION <> 2"), ["total_sofa"], 2)
    return extended.select("ID", "TIME", "ACTION", "SUB")


@query
def refine_states_query(spark, sf):
    """What the log and the tables of a refinement must satisfy."""
    trained = refine_states(event_steps(spark, sf), event_end_states(spark, sf), CONFIG)
    steps = trained.steps.agg(
        F.count(F.lit(1)).alias("n_rows"),
        (F.max("CLUSTER") + 1 == F.countDistinct("CLUSTER")).alias("states_are_dense"),
        F.countDistinct("CLUSTER").between(CONFIG.initial_states, CONFIG.max_states).alias("states_in_range"),
    )
    sums = trained.transitions.groupBy("CLUSTER", "ACTION").agg(F.sum("prob").alias("total"))
    whole = sums.agg(F.bool_and(F.abs(F.col("total") - 1) < 1e-9).alias("rows_sum_to_1"))
    return steps.join(F.broadcast(whole))


def sofa_forest(spark: SparkSession, sf: str):
    rows = sofa_steps(spark, sf)
    return rows, forest.forest_fit(rows, ["total_sofa"], "CLASS", 20, 5)


@query
def forest_fit(spark, sf):
    rows, model = sofa_forest(spark, sf)
    return forest.forest_predict(model, rows).groupBy("prediction").agg(F.count("*").alias("cnt"))


@query
def forest_predict(spark, sf):
    rows, model = sofa_forest(spark, sf)
    return forest.forest_predict(model, rows).select("ID", "TIME", "prediction")


@query
def forest_predict_proba(spark, sf):
    rows, model = sofa_forest(spark, sf)
    scored = forest.forest_predict_proba(model, rows)
    return scored.select("ID", "TIME", F.inline_outer(F.arrays_zip(
        F.transform("prob", lambda _, i: i).alias("class"), F.transform("prob", lambda p: F.round(p, 6)).alias("p")
    )))


def sofa_states(spark: SparkSession, sf: str) -> DataFrame:
    return sofa_steps(spark, sf).withColumn("CLUSTER", F.col("CLASS"))


@query
def surrogate_tree(spark, sf):
    steps = sofa_states(spark, sf)
    predicted = forest.forest_predict(forest.surrogate_tree(steps, ["total_sofa"]), steps)
    return predicted.groupBy("CLUSTER", "prediction").agg(F.count("*").alias("cnt"))


@query
def grid_search(spark, sf):
    return forest.grid_search(sofa_states(spark, sf), ["total_sofa"], depths=[3, 4])[1]


@query
def stratified_folds(spark, sf):
    """Rows of each class in each fold; the classes are sparse and one is negative."""
    steps = sofa_steps(spark, sf).withColumn("CLASS", F.col("CLASS") * 1_000_000 - 7)
    folds = forest.stratified_folds(steps, ["k", "value"], "CLASS")
    return folds.groupBy(F.col("_label").cast("int").alias("place"), "fold").agg(
        F.sum("weight").cast("long").alias("cnt")
    )


@query
def forest_sparse_classes(spark, sf):
    """Predicted labels and class lists of a forest on sparse and negative labels."""
    rows = sofa_steps(spark, sf).withColumn("CLASS", F.col("CLASS") * 1_000_000 - 7)
    model = forest.forest_fit(rows, ["total_sofa"], "CLASS", 20, 5)
    scored = forest.forest_class_probabilities(model, forest.forest_predict(model, rows))
    return scored.select("ID", "TIME", "prediction", F.inline_outer("classes")).select(
        "ID", "TIME", "prediction", "class", F.round("p", 6).alias("p")
    )


@query
def tree_rules(spark, sf):
    """The different conditions of the rules."""
    steps = sofa_states(spark, sf)
    rules = forest.tree_rules(forest.surrogate_tree(steps, ["total_sofa"]), steps)
    condition = F.regexp_extract("rule", r"\((total_sofa (?:<=|>) [0-9.]+)\)", 1)
    return rules.select(condition.alias("condition")).where("condition <> ''").distinct()


# ---------------------------------------------------------------- decision process


def swept_action_values(p: DataFrame, r: DataFrame, sweeps: int) -> DataFrame:
    values = run_sweeps(p, r, sweeps)
    return decision.bellman_backup(decision.attach_reward(p, r), values)


@query
def bellman_backup(spark, sf):
    return rounded(run_sweeps(*model_tables(spark, sf), 3), "v")


@query
def solve_policy_query(spark, sf):
    solution = solve_policy(*model_tables(spark, sf))
    return rounded(solution.values, "v")


@query
def action_values(spark, sf):
    q = decision.scale_values(swept_action_values(*model_tables(spark, sf), 2), 0.75)
    wide = profile.wide_matrix(q, "CLUSTER", "ACTION", "q", ACTIONS, "action_")
    return rounded(wide, *[f"action_{a}" for a in ACTIONS])


@query
def greedy_policy(spark, sf):
    return solve_policy(*model_tables(spark, sf)).policy


@query
def cumulative_transitions(spark, sf):
    return rounded(decision.cumulative_transitions(model_tables(spark, sf)[0]), "lo", "hi")


@query
def sample_transition(spark, sf):
    steps, ends = written_inputs(spark, sf)
    intervals = decision.cumulative_transitions(model_of(steps, ends)[0])
    rows = steps.select("ID", "TIME", "CLUSTER", "ACTION")
    drawn = decision.sample_transition(rows, intervals, 42, F.col("TIME"))
    return drawn.select("ID", "TIME", "CLUSTER", "ACTION", "SAMPLED")


def rolled(spark: SparkSession, sf: str, max_steps: int) -> DataFrame:
    steps, ends = written_inputs(spark, sf)
    p, r = model_of(steps, ends)
    absorbing = materialize(decision.terminal_states(dimension_of(steps, ends)))
    policy = solve_policy(p, r, CONFIG.gamma, CONFIG.epsilon).policy
    return policy_rollout(
        prepare.start_states(steps),
        p,
        policy,
        absorbing,
        max_steps,
        CONFIG.rollout_seed,
        CONFIG.steps_per_job,
    )


@query
def policy_rollout_query(spark, sf):
    return rolled(spark, sf, CONFIG.max_steps)


@query
def policy_rollout_three_steps(spark, sf):
    return rolled(spark, sf, 3)


@query
def terminal_states(spark, sf):
    return terminal(spark, sf)


@query
def most_likely_transition(spark, sf):
    return evaluate.most_likely_transition(model_tables(spark, sf)[0])


@query
def most_likely_path(spark, sf):
    steps, ends = written_inputs(spark, sf)
    return evaluate.most_likely_path(steps, model_of(steps, ends)[0])


@query
def policy_matrix(spark, sf):
    return rounded(solved_matrix(spark, sf)[2], "prob")


@query
def find_absorbing(spark, sf):
    return decision.find_absorbing(solved_matrix(spark, sf)[2])


@query
def absorption_probabilities_query(spark, sf):
    return rounded(absorption_probabilities(solved_matrix(spark, sf)[2]), "prob")


@query
def absorption_by_elimination(spark, sf):
    """The same by eliminating states, as large processes are solved."""
    matrix = solved_matrix(spark, sf)[2]
    return rounded(absorption_probabilities(matrix, fold_states=0), "prob")


def after_action(spark: SparkSession, sf: str) -> DataFrame:
    p, ends, matrix = solved_matrix(spark, sf)
    return decision.absorption_after_action(p, absorption_probabilities(matrix), ends)


@query
def absorption_after_action(spark, sf):
    return rounded(after_action(spark, sf), "prob")


@query
def absorption_report(spark, sf):
    """End-state distribution per state, and per state and first action, with names."""
    p, ends, matrix = solved_matrix(spark, sf)
    by_state = materialize(absorption_probabilities(matrix))
    by_action = decision.absorption_after_action(p, by_state, ends).where("ACTION IS NOT NULL")
    labels = end_dimension(spark, sf).select(
        F.col("END_INDEX").alias("END_STATE"), F.col("end_state").alias("label")
    )
    both = transitions.union_by_name(by_state, by_action)
    return rounded(prepare.name_end_states(both, labels), "prob")


# ---------------------------------------------------------------- quality


@query
def check_step_keys(spark, sf):
    """All steps, with every seventh repeated, some times and states missing."""
    steps = given_states(event_steps(spark, sf))
    odd = steps.withColumns(
        {
            "TIME": F.when(F.col("k") % 11 != 0, F.col("TIME") - 3),
            "CLUSTER": F.when(F.col("k") % 5 != 0, F.col("CLUSTER")),
            "ID": F.when(F.col("k") % 13 != 0, F.col("ID")),
        }
    )
    return quality.check_step_keys(odd.unionByName(odd.where("k % 7 = 0")))


@query
def check_row_sums(spark, sf):
    """State 0 loses its policy action, so its row is reported."""
    steps, ends = written_inputs(spark, sf)
    p, r = model_of(steps, ends)
    absorbing = decision.terminal_states(dimension_of(steps, ends))
    policy = solve_policy(p, r, CONFIG.gamma, CONFIG.epsilon).policy.where("CLUSTER <> 0")
    return quality.check_row_sums(decision.policy_matrix(p, policy, absorbing), r)


@query
def check_nonnegative(spark, sf):
    p = model_tables(spark, sf)[0].withColumn("prob", F.col("prob") - 0.01)
    return rounded(quality.check_nonnegative(p), "prob")


@query
def check_square(spark, sf):
    return quality.check_square(model_tables(spark, sf)[0])


@query
def check_absorbing(spark, sf):
    matrix = materialize(solved_matrix(spark, sf)[2])
    return quality.check_absorbing(matrix, decision.find_absorbing(matrix))


@query
def check_reachable(spark, sf):
    """States 0 and 1 are made to send all mass to each other, so it never ends."""
    p, ends, matrix = solved_matrix(spark, sf)
    circle = p.where("CLUSTER < 2").select("CLUSTER").distinct().select(
        "CLUSTER", (1 - F.col("CLUSTER")).alias("NEXT_CLUSTER"), F.lit(1.0).alias("prob")
    )
    circling = materialize(matrix.where("CLUSTER >= 2").unionByName(circle))
    left = quality.check_reachable(absorption_probabilities(circling), circling)
    return rounded(left, "residual")


@query
def check_action_row_query(spark, sf):
    p = model_tables(spark, sf)[0]
    pairs = profile.expand_grid(p.select("CLUSTER", "ACTION").distinct(), "CLUSTER", [*ACTIONS, 9], "ACTION")
    return quality.check_action_rows(p, pairs)
