"""Paths taken for long subjects, large lookups and hot keys give the same results."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from statepath.operators import decision, evaluate, incoherence, ordering, profile, transitions
from statepath.storage import join_lookup, materialize
from statepath.workload.queries import base_steps, event_end_states, vector_rows

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    """Steps with gaps in TIME, and one subject that owns a third of all rows."""
    steps = base_steps(spark, SMALL).withColumn("TIME", (F.col("TIME") * 3).cast("int"))
    hot = steps.where("CLUSTER = 2").withColumns(
        {"TIME": (F.col("TIME") * 40 + F.col("ID").cast("int")).cast("int"), "ID": F.lit("hot")}
    )
    both = materialize(steps.unionByName(hot.dropDuplicates(["ID", "TIME"])))
    ends = event_end_states(spark, SMALL)
    ends = ends.unionByName(ends.limit(1).withColumn("ID", F.lit("hot")))
    return both, materialize(ends)


@pytest.fixture(scope="module")
def model(inputs):
    labelled = transitions.next_state(*inputs)
    return materialize(transitions.transition_probabilities(labelled))


@pytest.mark.parametrize("width", [1, 7, 100])
def test_sliced_lead(inputs, width):
    columns = ["ID", "TIME", "NEXT_CLUSTER", "NEXT_RISK"]
    plain = transitions.next_state_and_risk(*inputs).select(*columns)
    sliced = transitions.next_state_and_risk(*inputs, width=width).select(*columns)
    assert rows(sliced) == rows(plain)


def test_null_next_value_falls_back(spark):
    steps = spark.createDataFrame(
        [("A", 0, 1), ("A", 1, None), ("A", 2, 3)], "ID string, TIME int, RISK int"
    )
    ends = spark.createDataFrame([("A", "home", 9)], "ID string, end_state string, Reward int")
    for width in (65_536, 1):
        filled = transitions.next_risk(steps, ends, width)
        assert rows(filled.select("TIME", "NEXT_RISK")) == [(0, 9), (1, 3), (2, 9)]


def test_numbering_by_slices(inputs):
    steps = inputs[0].withColumn("part", F.floor(F.col("TIME") / 10))
    plain = ordering.number_rows(steps, "ID", "part", ["TIME"])
    cut = ordering.number_rows(steps, "ID", "part", ["TIME"], window_rows=1)
    columns = ["ID", "TIME", "position"]
    assert rows(cut.select(*columns)) == rows(plain.select(*columns))


def test_subject_join_by_slices(inputs):
    steps, ends = inputs
    subjects = ends.select("ID", "Reward").where("ID <> '3'")
    plain = ordering.join_subject(steps, subjects).select("ID", "TIME", "Reward")
    cut = ordering.join_subject(steps, subjects, width=5).select("ID", "TIME", "Reward")
    assert rows(cut) == rows(plain)


def test_paths_by_blocks_and_joins(inputs, model):
    steps = inputs[0].where("TIME < 60")
    whole = rows(evaluate.most_likely_path(steps, model))
    assert rows(evaluate.most_likely_path(steps, model, width=4)) == whole


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup(inputs, how):
    steps = inputs[0].select("ID", "TIME", "CLUSTER", "ACTION")
    lookup = steps.where("ACTION <> 2").groupBy("CLUSTER", "ACTION").agg(F.max("TIME").alias("m"))
    small = join_lookup(steps, lookup, ["CLUSTER", "ACTION"], how)
    salted = join_lookup(steps, lookup, ["CLUSTER", "ACTION"], how, limit=0)
    assert small.columns == salted.columns
    assert rows(small) == rows(salted)


def test_salted_sampling(inputs, model):
    steps = inputs[0].select("ID", "TIME", "CLUSTER", "ACTION")
    intervals = decision.cumulative_transitions(model)
    drawn = decision.sample_transition(steps, intervals, 1, F.col("TIME"))
    salted = decision.sample_transition(steps, intervals, 1, F.col("TIME"), limit=0)
    assert rows(drawn) == rows(salted)
    assert drawn.count() == steps.count()
    known = model.select("CLUSTER", "ACTION", F.col("NEXT_CLUSTER").alias("SAMPLED"))
    assert drawn.join(known, ["CLUSTER", "ACTION", "SAMPLED"], "left_anti").isEmpty()


def test_quartiles_over_many_slices(inputs):
    wide = inputs[0].withColumn("TIME", (F.col("TIME") * 50_021).cast("int"))
    exact = wide.groupBy("CLUSTER").agg(
        *[F.percentile("TIME", F.lit(q)).alias(n) for n, q in profile.QUARTILES.items()]
    )
    mine = profile.time_profile(wide).select("CLUSTER", *profile.QUARTILES)
    assert rows(mine) == rows(exact)


def test_results_do_not_depend_on_partitioning(inputs):
    steps, ends = inputs
    p = transitions.transition_probabilities(transitions.next_state(steps, ends))
    shuffled = transitions.next_state(steps.repartition(5, "RISK"), ends.repartition(3))
    assert rows(transitions.transition_probabilities(shuffled)) == rows(p)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, inputs):
    steps, ends = inputs
    labelled = transitions.next_state(steps, ends)
    p = transitions.transition_probabilities(labelled)
    radius = incoherence.information_radius(materialize(vector_rows(spark, SMALL)), 3)
    for df in (labelled, p, radius):
        plan = plan_of(df)
        assert "EvalPython" not in plan
        assert "collect_list" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # only the columns in use are read, and only end-state names are ranked in one place
    assert "ReadSchema: struct<ID:string,TIME:int,ACTION:int,CLUSTER:int>" in plan_of(p)
    assert plan_of(labelled).count("SinglePartition") <= 1


def test_absorption_is_a_distribution_and_matches_rollout(spark, inputs, model):
    from statepath.operators.prepare import start_states
    from statepath.plans.absorb import absorption_probabilities
    from statepath.plans.rollout import policy_rollout

    steps, ends = inputs
    terminal = decision.terminal_states(transitions.end_state_dimension(ends, 3))
    policy = model.groupBy("CLUSTER").agg(F.min("ACTION").alias("ACTION"))
    matrix = decision.policy_matrix(model, policy, terminal)
    absorbed = materialize(absorption_probabilities(matrix))
    for _, total in rows(absorbed.groupBy("CLUSTER").agg(F.sum("prob"))):
        assert total == pytest.approx(1.0, abs=1e-6)

    n = 2_000
    starts = spark.range(n).select(F.col("id").cast("string").alias("ID"), F.lit(0).alias("CLUSTER"))
    rolled = materialize(policy_rollout(starts, model, policy, terminal))
    assert rolled.groupBy("ID", "TIME").count().where("count > 1").isEmpty()
    spans = rolled.groupBy("ID").agg(F.max("TIME").alias("last"), F.count("*").alias("n"))
    assert spans.where("n <> last + 1").isEmpty()
    share = dict(rows(rolled.where("ACTION IS NULL").groupBy("CLUSTER").agg(F.count("*") / n)))
    for end, prob in rows(absorbed.where("CLUSTER = 0").select("END_STATE", "prob")):
        error = (prob * (1 - prob) / n) ** 0.5
        assert abs(share.get(end, 0.0) - prob) <= 4 * error + 1e-9
    assert start_states(steps).count() == steps.select("ID").distinct().count()
