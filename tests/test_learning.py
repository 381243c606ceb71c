"""Forests, k-means and the refinement loop, by their invariants."""

import math

import pytest
from pyspark.errors import SparkRuntimeException
from conftest import rows
from pyspark.sql import functions as F

from statepath.config import Config
from statepath.operators import forest, prepare, transitions
from statepath.plans.refine import apply_split, prepare_steps, refine_states
from statepath.sources import event_end_states, event_steps
from statepath.storage import materialize
from statepath.workload.queries import given_states

SMALL = "/root/testdata/sf0.001"
FEATURES = ["k", "value", "total_sofa"]


@pytest.fixture(scope="module")
def raw(spark):
    return materialize(event_steps(spark, SMALL)), materialize(event_end_states(spark, SMALL))


@pytest.fixture(scope="module")
def steps(raw):
    prepared = given_states(prepare_steps(raw[0], Config()))
    return materialize(transitions.next_state(prepared, raw[1]))


def test_initial_states_minimise_distance(raw):
    found = forest.initial_states(prepare_steps(raw[0], Config()), 3)
    by_risk = rows(found.select("RISK", "CLUSTER").distinct())
    values = dict(by_risk)
    assert len(values) == len(by_risk)
    centres = dict(rows(found.groupBy("CLUSTER").agg(F.avg("RISK"))))
    assert sorted(centres) == [0, 1, 2]
    assert centres[0] < centres[1] < centres[2]
    for risk, cluster in values.items():
        assert abs(risk - centres[cluster]) <= min(abs(risk - c) for c in centres.values()) + 0.5


def test_given_states_are_kept(steps):
    assert rows(forest.initial_states(steps).select("ID", "TIME", "CLUSTER")) == rows(
        steps.select("ID", "TIME", "CLUSTER")
    )


def test_next_state_distribution(steps):
    model = forest.next_state_classifier(steps, FEATURES, 5, 4)
    scored = forest.next_state_distribution(model, steps)
    size = forest.class_count(model)
    assert size == steps.agg(F.max("NEXT_CLUSTER")).first()[0] + 1
    total = F.aggregate("prob", F.lit(0.0), lambda a, x: a + x)
    assert scored.where((F.size("prob") != size) | (F.abs(total - 1) > 1e-9)).isEmpty()
    assert scored.count() == steps.count()


def test_probability_index_is_the_label(spark):
    data = spark.createDataFrame(
        [(float(x), label) for x in range(40) for label in [[0, 1, 3][x % 3]]], "x double, y int"
    ).withColumn("x", F.col("y") * 10.0)
    model = forest.forest_fit(data, ["x"], "y", 5, 3)
    scored = forest.forest_predict_proba(model, data)
    assert scored.where(F.get("prob", F.col("y")) < 0.9).isEmpty()
    assert scored.where(F.get("prob", F.lit(2)) > 0).isEmpty()


def test_unusable_rows_keep_their_key(spark):
    data = spark.createDataFrame(
        [("a", 1.0, 0), ("b", 9.0, 1), ("c", None, 0), ("d", math.nan, 1)] * 5,
        "ID string, x double, y int",
    )
    model = forest.forest_fit(data, ["x"], "y", 5, 2)
    predicted = forest.forest_predict(model, data).select("ID", "prediction").distinct()
    assert rows(predicted, "ID") == [("a", 0), ("b", 1), ("c", None), ("d", None)]
    assert rows(prepare.count_invalid(data, ["x"])) == [(10, 10)]


def test_split_separates_and_extends(steps):
    vectors = steps.withColumn(
        "prob", F.when(F.col("k") < 50, F.array(F.lit(1.0), F.lit(0.0))).otherwise(
            F.array(F.lit(0.0), F.lit(1.0)))
    ).withColumn("NEXT_CLUSTER", F.when(F.col("k") < 50, 0).otherwise(5))
    state = materialize(vectors.where("CLUSTER = 1"))
    halves = forest.split_state(state.where("ACTION = 2"), 2)
    assert halves.where((F.col("SUB") == 0) != (F.col("k") < 50)).isEmpty()
    extended = forest.extend_split(halves, state.where("ACTION <> 2"), FEATURES, 2, 5, 4)
    assert extended.count() == state.count()
    assert extended.where((F.col("SUB") == 0) != (F.col("k") < 50)).isEmpty()


def test_apply_split_changes_only_its_state(raw, steps):
    halves = steps.where("CLUSTER = 1").withColumn("SUB", (F.col("k") >= 50).cast("int"))
    split = materialize(apply_split(steps, halves, 1, 3, raw[1]))
    others = ["ID", "TIME", "CLUSTER"]
    assert rows(split.where("CLUSTER NOT IN (1, 3)").select(*others)) == rows(
        steps.where("CLUSTER <> 1").select(*others)
    )
    assert split.agg(F.max("NEXT_CLUSTER")).first()[0] == steps.agg(F.max("NEXT_CLUSTER")).first()[0] + 1
    ended = split.where("NEXT_CLUSTER > 3").groupBy("ID").count()
    assert ended.where("count <> 1").isEmpty()
    assert ended.count() == split.select("ID").distinct().count()


def test_refinement(raw):
    config = Config(max_states=4, min_obs=20, min_splitoff=5, forest_trees=5, split_trees=5)
    trained = refine_states(*raw, config)
    states = [r[0] for r in rows(trained.steps.select("CLUSTER").distinct())]
    log = trained.log.collect()
    accepted = [r for r in log if r.accepted]
    assert len(states) == 3 + len(accepted) <= config.max_states
    assert trained.steps.count() + trained.dropped == raw[0].count()
    assert trained.steps.columns == ["ID", "TIME", *FEATURES, "ACTION", "RISK", "CLUSTER", "NEXT_CLUSTER"]
    for row in log:
        assert 0 <= row.incoherence <= math.log(2)
        assert row.accepted == (min(row.size_0, row.size_1) >= config.min_splitoff)
        assert (row.mae is not None) == row.accepted
    sums = trained.transitions.groupBy("CLUSTER", "ACTION").agg(F.sum("prob").alias("s"))
    assert sums.where(F.abs(F.col("s") - 1) > 1e-9).isEmpty()
    known = trained.rewards.select(F.col("CLUSTER").alias("NEXT_CLUSTER"))
    assert trained.transitions.join(known, "NEXT_CLUSTER", "left_anti").isEmpty()


def plain_radius(rows_, least):
    """Mean Jensen-Shannon divergence to the mean of each group with enough rows."""
    groups = {}
    for key, vector in rows_:
        groups.setdefault(key, []).append(vector)
    found = {}
    for key, vectors in groups.items():
        mean = [sum(x) / len(vectors) for x in zip(*vectors)]
        entropy = lambda v: -sum(p * math.log(p) for p in v if p > 0)
        each = [entropy([(p + q) / 2 for p, q in zip(v, mean)]) - (entropy(v) + entropy(mean)) / 2 for v in vectors]
        if len(vectors) >= least:
            found[key] = (sum(each) / len(vectors), len(vectors))
    return found


def test_refinement_chooses_and_accepts_as_brute_force(raw, monkeypatch):
    from statepath.plans import refine

    config = Config(max_states=5, min_obs=20, min_splitoff=5, forest_trees=5, split_trees=5)
    scored, halves = [], []
    radius, worst = refine.incoherence.information_radius, refine.incoherence.worst_action

    def noted_radius(rows_, *args, **options):
        if "SUB" not in rows_.columns:
            scored.append(rows_.where("NEXT_CLUSTER is not null").select("CLUSTER", "ACTION", "prob").collect())
        return radius(rows_, *args, **options)

    def noted_worst(rows_, *args, **options):
        halves.append(rows_.where("NEXT_CLUSTER is not null").select("SUB", "ACTION", "prob").collect())
        return worst(rows_, *args, **options)

    monkeypatch.setattr(refine.incoherence, "information_radius", noted_radius)
    monkeypatch.setattr(refine.incoherence, "worst_action", noted_worst)
    log = refine_states(*raw, config).log.collect()
    tried, accepted = set(), iter(halves)
    for row in log:
        ranked = plain_radius([((r.CLUSTER, r.ACTION), list(r.prob)) for r in scored[row.iteration]], config.min_obs)
        left = {k: v for k, v in ranked.items() if k not in tried}
        best = max(v[0] for v in left.values())
        assert left[row.cluster, row.action][0] == pytest.approx(best, abs=1e-9)
        assert (row.incoherence, row.cnt) == (pytest.approx(best, abs=1e-9), left[row.cluster, row.action][1])
        tried.add((row.cluster, row.action))
        assert row.accepted == (min(row.size_0, row.size_1) >= config.min_splitoff)
        if row.accepted:
            own = plain_radius([((r.SUB, r.ACTION), list(r.prob)) for r in next(accepted)], config.min_splitoff)
            for half, shown in enumerate((row.incoherence_0, row.incoherence_1)):
                values = [v[0] for k, v in own.items() if k[0] == half]
                assert shown == (pytest.approx(max(values), abs=1e-9) if values else None)
    assert any(r.accepted for r in log)


def test_refinement_reads_its_source_once(spark, raw, tmp_path):
    steps, ends = raw
    steps.write.parquet(f"{tmp_path}/steps")
    seen = spark.sparkContext.accumulator(0)
    total = steps.count()

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = spark.read.parquet(f"{tmp_path}/steps")
    source = source.mapInArrow(watched, source.schema)
    refine_states(source, ends, Config(max_states=4, min_obs=20, min_splitoff=5, forest_trees=2, split_trees=2))
    assert seen.value == total


def test_refinement_refuses_two_steps_at_one_time(raw):
    steps, ends = raw
    with pytest.raises(SparkRuntimeException, match="two steps of subject"):
        refine_states(steps.unionByName(steps.limit(1)), ends, Config(min_obs=10**9))


def test_refinement_without_candidates(raw):
    trained = refine_states(*raw, Config(min_obs=10**9, forest_trees=2))
    assert trained.log.isEmpty()
    assert trained.steps.select("CLUSTER").distinct().count() == 3


def test_surrogate_tree_and_rules(steps):
    search, table = forest.grid_search(steps, FEATURES, (2, 4), folds=3)
    assert [r.max_depth for r in table.collect()] == [2, 4]
    rules = [r.rule for r in forest.tree_rules(search, steps).collect()]
    assert any(name in rule for rule in rules for name in FEATURES)
    assert not any("feature " in rule for rule in rules)
    assert any(rule.startswith("Predict") for rule in rules)


def test_more_than_a_hundred_classes(spark):
    data = spark.range(2_400).select((F.col("id") % 120).cast("int").alias("x"))
    rows_ = materialize(data.withColumn("y", F.col("x")))
    model = forest.forest_fit(rows_, ["x"], "y", 3, 10)
    assert forest.class_count(model) == 120
    tree = forest.surrogate_tree(rows_.withColumn("CLUSTER", F.col("x")), ["x"], 10)
    assert forest.forest_predict(tree, rows_).where("prediction is null").isEmpty()


def test_sparse_and_negative_classes(spark, tmp_path):
    data = spark.createDataFrame(
        [(float(x % 3), [-5, 7, 1_000_000][x % 3]) for x in range(60)], "x double, y int"
    )
    model = forest.forest_fit(data, ["x"], "y", 5, 3)
    assert forest.class_list(model) == [-5, 7, 1_000_000]
    assert forest.forest_predict(model, data).where("prediction <> y").isEmpty()
    with pytest.raises(ValueError, match="negative"):
        forest.forest_predict_proba(model, data)
    scored = forest.forest_class_probabilities(model, data)
    right = F.filter("classes", lambda c: c["class"] == F.col("y"))
    assert scored.where((F.size("classes") != 3) | (F.get(right, F.lit(0))["p"] < 0.9)).isEmpty()
    model.write().save(str(tmp_path / "model"))
    again = type(model).load(str(tmp_path / "model"))
    assert forest.class_list(again) == [-5, 7, 1_000_000]


def test_a_single_class(spark):
    data = spark.createDataFrame([(float(x), 4) for x in range(20)], "x double, y int")
    model = forest.forest_fit(data, ["x"], "y", 3, 3)
    scored = forest.forest_predict_proba(model, forest.forest_predict(model, data))
    assert rows(scored.select("prediction", "prob").distinct()) == [(4, [0.0, 0.0, 0.0, 0.0, 1.0])]


def test_labels_no_forest_can_take(spark):
    with pytest.raises(ValueError, match="whole"):
        forest.forest_fit(spark.createDataFrame([(1.0, 0.5)], "x double, y double"), ["x"], "y")
    with pytest.raises(ValueError, match="no row"):
        forest.forest_fit(spark.createDataFrame([], "x double, y int"), ["x"], "y")


def test_a_thousand_classes(spark):
    data = materialize(spark.range(4_000).select((F.col("id") % 1_000 * 3 - 9).cast("int").alias("x")))
    model = forest.forest_fit(data.withColumn("y", F.col("x")), ["x"], "y", 1, 4)
    assert forest.class_list(model) == list(range(-9, 2_991, 3))


def test_folds_are_stratified_and_repeatable(spark):
    """A third of the rows are one row, classes are uneven, one has a single row."""
    plain = [(float(x % 97), [0, 0, 0, 4, 9][x % 5]) for x in range(600)]
    data = spark.createDataFrame([*plain, *[(5.0, 0)] * 300, (1.0, 77)], "x double, y int")
    dealt = forest.stratified_folds(data, ["x"], "y", 5)
    sizes = {}
    for place, fold, n in rows(dealt.groupBy("_label", "fold").agg(F.sum("weight"))):
        sizes.setdefault(place, [0] * 5)[fold] += n
    assert {k: sum(v) for k, v in sizes.items()} == {0: 660, 1: 120, 2: 120, 3: 1}
    assert all(max(v) - min(v) <= 1 for v in sizes.values())
    moved = forest.stratified_folds(data.repartition(7), ["x"], "y", 5)
    assert rows(moved, "x", "_label", "fold") == rows(dealt, "x", "_label", "fold")
    other = forest.stratified_folds(data, ["x"], "y", 5, seed=1)
    assert rows(other, "x", "_label", "fold") != rows(dealt, "x", "_label", "fold")


def test_rules_name_the_labels(spark):
    data = spark.createDataFrame([(float(x), [3, 40][x > 9]) for x in range(20)], "x double, CLUSTER int")
    for model in (forest.surrogate_tree(data, ["x"]), forest.grid_search(data, ["x"])[0]):
        said = {r.rule for r in forest.tree_rules(model, data).collect() if "Predict" in r.rule}
        assert said == {"Predict: 3.0", "Predict: 40.0"}
