"""What a size check decides must not change results: both branches on awkward rows."""

import numpy as np
import pytest
from conftest import rows
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from statepath.operators import evaluate, ordering, prepare, profile, quality, transitions
from statepath.plans import absorb, solve


def test_numbering_keeps_rows_without_a_time(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", None, 2), ("a", 5, 3), ("a", 15, 4), ("b", None, 5)],
        "ID string, ts int, n int",
    ).withColumn("slice", F.floor(F.col("ts") / 10))
    plain, sliced = (
        ordering.number_rows(df, "ID", "slice", ["ts", "n"], limit).select("ID", "n", "position")
        for limit in (100, 1)
    )
    assert rows(plain) == rows(sliced) and len(rows(plain)) == 5


def test_ordered_steps_agree_with_null_times(spark):
    steps = spark.createDataFrame(
        [("a", None, 7), ("a", 0, 1), ("a", 3, 2), ("a", 9, 3), ("b", None, 4), ("c", 2, 5)],
        "ID string, TIME int, CLUSTER int",
    )
    subjects = spark.createDataFrame([("a", 70), ("b", 80)], "ID string, END int")
    for width in (2, 4):
        joined = [ordering.join_subject(steps, subjects, s, width) for s in (False, True)]
        assert rows(joined[0].select(sorted(joined[0].columns))) == rows(
            joined[1].select(sorted(joined[1].columns))
        )
        led = [
            ordering.lead_values(steps, {"NEXT": "CLUSTER"}, subjects, {"NEXT": "END"}, s, width)
            for s in (False, True)
        ]
        assert rows(led[0]) == rows(led[1])


@pytest.mark.parametrize("fold_states", [0, 64])
def test_absorption_of_a_slow_leak_is_whole(spark, fold_states):
    leak = 4e-12
    matrix = spark.createDataFrame(
        [(0, 0, 1 - leak), (0, 1, leak), (1, 1, 1.0), (2, 0, 0.5), (2, 3, 0.5), (3, 4, 1.0), (4, 3, 1.0)],
        "CLUSTER int, NEXT_CLUSTER int, prob double",
    )
    found = absorb.absorption_probabilities(matrix, fold_states=fold_states)
    shown = {(r.CLUSTER, r.END_STATE): r.prob for r in found.collect()}
    assert shown.keys() == {(0, 1), (1, 1), (2, 1)}
    assert shown[0, 1] == pytest.approx(1, abs=1e-9) and shown[2, 1] == pytest.approx(0.5, abs=1e-9)


@pytest.mark.parametrize("fold_states", [0, 64])
def test_absorption_along_a_chain_and_in_several_models(spark, fold_states):
    chain = [("m", i, i + 1, 0.5) for i in range(20)] + [("m", i, 21, 0.5) for i in range(20)]
    chain += [("m", 20, 20, 1.0), ("m", 21, 21, 1.0), ("n", 0, 1, 1.0), ("n", 1, 1, 1.0)]
    matrix = spark.createDataFrame(chain, "model string, CLUSTER int, NEXT_CLUSTER int, prob double")
    found = absorb.absorption_probabilities(matrix, by=["model"], fold_states=fold_states)
    shown = {(r.model, r.CLUSTER, r.END_STATE): r.prob for r in found.collect()}
    for i in range(20):
        assert shown["m", i, 20] == pytest.approx(0.5 ** (20 - i))
        assert shown["m", i, 21] == pytest.approx(1 - 0.5 ** (20 - i))
    assert shown["n", 0, 1] == 1


def test_absorption_along_a_long_chain_needs_few_rounds_and_no_square_table(spark, monkeypatch):
    """Each state of a chain moves on or leaks; nothing is squared until few states are left."""
    from statepath.plans import eliminate

    turns = []
    keep = eliminate._scaled
    monkeypatch.setattr(eliminate, "_scaled", lambda *a: turns.append(1) or keep(*a))
    monkeypatch.setattr(absorb, "square_matrix", lambda *a: pytest.fail("squared by joins"))
    n = 20_000
    up, leak = 1 - 1e-4, 1e-4
    state = F.col("id").cast("int")
    chain = spark.range(n)
    parts = [
        chain.select(state, (state + 1), F.lit(up)),
        chain.select(state, F.lit(n + 1), F.lit(leak)),
        spark.range(n, n + 2).select(state, state, F.lit(1.0)),
    ]
    matrix = parts[0].union(parts[1]).union(parts[2]).toDF("CLUSTER", "NEXT_CLUSTER", "prob")
    found = absorb.absorption_probabilities(matrix)
    expected = F.pow(F.lit(up), F.lit(n) - F.col("CLUSTER"))
    wanted = F.when(F.col("END_STATE") == n, expected).otherwise(1 - expected)
    inner = found.where(F.col("CLUSTER") < n)
    assert inner.count() == 2 * n and found.count() == 2 * n + 2
    assert inner.where(F.abs(F.col("prob") - wanted) > 1e-9).isEmpty()
    assert len(turns) < 40


@pytest.mark.parametrize("fold_states", [0, 12, 64])
def test_absorption_of_random_processes_equals_a_linear_solve(spark, fold_states):
    """Two models with loops, slow leaks, closed circles and states that only loop back."""
    rng = np.random.default_rng(5)
    wanted, cells = {}, []
    for model, size in (("m", 40), ("n", 25)):
        p = np.zeros((size, size))
        for s in range(size - 6):
            targets = rng.choice(size, 3, replace=False)
            p[s, targets] = rng.random(3) + 0.01
            p[s, s] += rng.choice([0.0, 1.0, 1e6])
            p[s] /= p[s].sum()
        p[size - 6, size - 5] = p[size - 5, size - 6] = 1
        for s in range(size - 4, size):
            p[s, s] = 1
        inner = np.arange(size - 6)
        ends = np.arange(size - 4, size)
        answer = np.linalg.solve(np.eye(size - 6) - p[np.ix_(inner, inner)], p[np.ix_(inner, ends)])
        wanted |= {(model, int(s), int(e)): answer[s, j] for s in inner for j, e in enumerate(ends)}
        wanted |= {(model, int(e), int(e)): 1.0 for e in ends}
        cells += [(model, int(a), int(b), float(p[a, b])) for a, b in zip(*p.nonzero())]
    matrix = spark.createDataFrame(cells, "model string, CLUSTER int, NEXT_CLUSTER int, prob double")
    found = absorb.absorption_probabilities(matrix, by=["model"], fold_states=fold_states)
    shown = {(r.model, r.CLUSTER, r.END_STATE): r.prob for r in found.collect()}
    assert shown.keys() <= wanted.keys()
    for key, value in wanted.items():
        assert shown.get(key, 0.0) == pytest.approx(value, abs=1e-8)


def test_absorption_refuses_invalid_matrices(spark):
    for bad in ([(0, 1, 1.0)], [(0, 0, 0.5)], [(0, 0, 1.5), (0, 1, -0.5), (1, 1, 1.0)]):
        matrix = spark.createDataFrame(bad, "CLUSTER int, NEXT_CLUSTER int, prob double")
        with pytest.raises(ValueError, match="sum to 1"):
            absorb.absorption_probabilities(matrix)


def test_solver_forms_stop_alike_for_several_models(spark):
    p = [("a", 0, 0, 0, 0.99), ("a", 0, 0, 1, 0.01), ("a", 0, 1, 1, 1.0), ("b", 0, 0, 1, 1.0)]
    r = [("a", 0, 1.0), ("a", 1, 5.0), ("b", 0, 2.0), ("b", 1, 0.0)]
    transitions_ = spark.createDataFrame(p, "model string, CLUSTER int, ACTION int, NEXT_CLUSTER int, prob double")
    rewards = spark.createDataFrame(r, "model string, CLUSTER int, RISK double")
    values = []
    for fold_rows in (0, 1_000):
        solved = solve.solve_policy(transitions_, rewards, 0.99, 1e-4, ["model"], fold_rows)
        values.append({(x.model, x.CLUSTER): x.v for x in solved.values.collect()})
    assert values[0].keys() == values[1].keys()
    assert all(values[0][k] == pytest.approx(values[1][k], abs=1e-13) for k in values[0])


def test_solver_refuses_missing_rewards_and_wide_gamma(spark):
    p = spark.createDataFrame([(0, 0, 7, 1.0), (0, 1, 1, 1.0)], "CLUSTER int, ACTION int, NEXT_CLUSTER int, prob double")
    r = spark.createDataFrame([(0, 1.0), (1, 5.0)], "CLUSTER int, RISK double")
    for fold_rows in (0, 1_000):
        with pytest.raises(SparkRuntimeException, match="no value for state 7"):
            solve.solve_policy(p, r, fold_rows=fold_rows)
    with pytest.raises(SparkRuntimeException, match="no reward for state 0"):
        solve.solve_policy(p, r.where("CLUSTER = 1"))
    with pytest.raises(ValueError, match="gamma"):
        solve.solve_policy(p, r, gamma=1.0)


def test_a_split_loses_no_rows(spark):
    steps = spark.createDataFrame(
        [(1, 0), (1, 1), (1, None), (2, 0), (None, 0), (None, None)], "CLUSTER int, ACTION int"
    )
    parts = [
        prepare.state_action_slice(steps, 1, 0),
        prepare.state_other_actions(steps, 1, 0),
        prepare.state_rest(steps, 1),
    ]
    assert [x.count() for x in parts] == [1, 2, 3]


def test_action_shares_are_of_all_rows(spark):
    steps = spark.createDataFrame([(0, 0), (0, 1), (0, 7), (0, 7)], "CLUSTER int, ACTION int")
    assert rows(profile.action_frequency_by_state(steps, [0, 1])) == [(0, 0, 0.25), (0, 1, 0.25)]


def test_step_contract_with_a_hot_repeated_key(spark):
    hot = spark.range(100_000).select(F.lit("a").alias("ID"), F.lit(1).alias("TIME"))
    other = spark.createDataFrame([("b", None), (None, 2), ("c", -1), ("d", 1)], "ID string, TIME int")
    found = {r.problem: r.n_rows for r in quality.check_step_keys(hot.union(other)).collect()}
    assert found == {
        "no subject": 1, "no time": 1, "negative time": 1, "repeated key": 100_000, "no given state": 0,
    }


def test_end_state_names_are_broadcast_whatever_the_threshold(spark):
    ends = spark.createDataFrame([(str(i), "xyz"[i % 3], i % 3) for i in range(300)], "ID string, end_state string, Reward int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = transitions.index_end_states(ends, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("width", [2, 100])
def test_repeated_steps_are_refused_where_order_matters(spark, width):
    steps = spark.createDataFrame(
        [("a", 0, 1, 0, 1), ("a", 3, 2, 0, 1), ("a", 3, 1, 1, 1), ("b", 0, 1, 0, 1)],
        "ID string, TIME int, CLUSTER int, ACTION int, RISK int",
    )
    ends = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "ID string, end_state string, Reward int")
    for df in (
        transitions.next_state(steps, ends, width), transitions.next_risk(steps, ends, width),
        evaluate.subject_sequences(steps, width),
    ):
        with pytest.raises(SparkRuntimeException, match="two steps of subject a at time 3"):
            df.collect()


def test_many_copies_of_one_step_never_become_an_array(spark):
    hot = spark.range(100_000).select(F.lit("a").alias("ID"), F.lit(1).alias("TIME"), F.lit(0).alias("CLUSTER"), F.lit(0).alias("ACTION"))
    with pytest.raises(SparkRuntimeException, match="two steps of subject a at time 1"):
        evaluate.subject_sequences(hot).collect()
