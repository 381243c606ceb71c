"""Values worked out by hand for the seven-row fixture."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from statepath.operators import decision, evaluate, incoherence, prepare, transitions
from statepath.plans import absorb, rollout, solve

P = [
    (0, 0, 0, 0.333333),
    (0, 0, 1, 0.333333),
    (0, 0, 3, 0.333333),
    (0, 1, 1, 1.0),
    (1, 0, 2, 1.0),
    (1, 1, 0, 0.5),
    (1, 1, 3, 0.5),
]


@pytest.mark.parametrize("width", [65_536, 2, 1])
def test_next_state_and_risk(golden, width):
    both = transitions.next_state_and_risk(*golden, width=width)
    assert rows(both.select("ID", "TIME", "NEXT_CLUSTER", "NEXT_RISK"), "ID", "TIME") == [
        ("A", 0, 1, 2),
        ("A", 1, 3, 0),
        ("B", 0, 0, 1),
        ("B", 1, 1, 4),
        ("B", 2, 2, 10),
        ("C", 0, 0, 1),
        ("C", 2, 3, 0),
    ]


def test_existing_next_cluster_is_replaced(golden):
    steps, ends = golden
    stale = steps.withColumn("NEXT_CLUSTER", F.lit(99))
    renewed = transitions.next_state(stale, ends)
    assert renewed.where("NEXT_CLUSTER = 99").isEmpty()
    assert renewed.columns.count("NEXT_CLUSTER") == 1


def test_subject_without_end_state(golden):
    steps, ends = golden
    labelled = transitions.next_state(steps, ends.where("ID <> 'A'"))
    assert rows(labelled.where("NEXT_CLUSTER IS NULL").select("ID", "TIME")) == [("A", 1)]
    assert transitions.transition_counts(labelled).agg(F.sum("cnt")).first()[0] == 6


def test_model(golden_model):
    p, r = golden_model
    assert rows(p) == P
    assert rows(r) == [(0, 1.0), (1, 2.666667), (2, 10.0), (3, 0.0)]
    assert rows(transitions.expected_next_risk(p, r)) == [
        (0, 0, 1.222222),
        (0, 1, 2.666667),
        (1, 0, 10.0),
        (1, 1, 0.5),
    ]


def test_end_state_rewards_must_agree(spark, golden):
    steps, ends = golden
    wrong = ends.union(spark.createDataFrame([("D", "home", 3)], ends.schema))
    with pytest.raises(Exception, match="two Rewards for end state home"):
        transitions.reward_table(steps, wrong).collect()


def test_subjects_must_be_unique(spark, golden):
    steps, ends = golden
    wrong = ends.union(spark.createDataFrame([("A", "home", 0)], ends.schema))
    for make in (transitions.next_state, transitions.next_risk):
        with pytest.raises(Exception, match="two end states for subject A"):
            make(steps, wrong).collect()


def test_one_step_reward_error(golden, golden_model):
    steps, ends = golden
    assert rows(evaluate.one_step_reward_error(steps, *golden_model, ends)) == [
        (0.650794, 0.632275, 0.941544)
    ]


def test_one_step_reward_error_without_spread(spark, golden_model):
    steps = spark.createDataFrame(
        [("A", 0, 0, 0, 5), ("A", 1, 0, 0, 5)],
        "ID string, TIME int, CLUSTER int, ACTION int, RISK int",
    )
    ends = spark.createDataFrame([("A", "home", 5)], "ID string, end_state string, Reward int")
    assert evaluate.one_step_reward_error(steps, *golden_model, ends).first().r2 is None


def test_stddev_incoherence(golden):
    labelled = transitions.next_state(*golden)
    assert rows(incoherence.stddev_incoherence(labelled, 1), F.desc("incoherence")) == [
        (1, 1, 2.12132, 2),
        (0, 0, 1.527525, 3),
    ]


@pytest.mark.parametrize("limit", [None, 0])
def test_information_radius(spark, limit):
    vectors = spark.createDataFrame(
        [
            ("A", 0, 0, 0, 1, [1.0, 0.0]),
            ("A", 1, 0, 0, 1, [0.0, 1.0]),
            ("B", 0, 1, 0, 1, [0.5, 0.5]),
            ("B", 1, 1, 1, None, [0.5, 0.5]),
        ],
        "ID string, TIME int, CLUSTER int, ACTION int, NEXT_CLUSTER int, prob array<double>",
    )
    radius = incoherence.information_radius(vectors, 2, limit=limit)
    assert rows(radius) == [(0, 0, 0.215762, 2), (1, 0, 0.0, 1)]


@pytest.mark.parametrize(
    "sweeps, expected",
    [(1, [1.0, 2.666667]), (2, [2.1, 3.116667]), (3, [2.565, 3.611667])],
)
def test_sweeps(golden_model, sweeps, expected):
    values = rows(solve.run_sweeps(*golden_model, sweeps), "CLUSTER")
    assert [v for _, v in values] == [*expected, 10.0, 0.0]


def test_solve_policy(golden_model):
    solution = solve.solve_policy(*golden_model)
    assert rows(solution.policy) == [(0, 0), (1, 1)]
    assert rows(solution.values) == [(0, 3.185841), (1, 4.100295), (2, 10.0), (3, 0.0)]
    assert rows(solution.action_values) == [
        (0, 0, 3.185841),
        (0, 1, 4.690265),
        (1, 0, 11.666667),
        (1, 1, 4.100295),
    ]


@pytest.mark.parametrize("broadcast_limit", [None, 0])
def test_solve_policy_by_joins(golden_model, broadcast_limit):
    folded = solve.solve_policy(*golden_model, gamma=0.3)
    joined = solve.solve_policy(
        *golden_model, gamma=0.3, fold_rows=0, broadcast_limit=broadcast_limit
    )
    assert rows(joined.values) == rows(folded.values)
    assert rows(joined.policy) == rows(folded.policy)


def test_best_action_breaks_ties_low(spark):
    q = spark.createDataFrame([(0, 2, 1.0), (0, 1, 1.0), (0, 3, 2.0)], "CLUSTER int, ACTION int, q double")
    assert rows(decision.best_action(q)) == [(0, 1)]


def test_many_models_at_once(spark, golden_model, golden):
    both = F.explode(F.array(F.lit("x"), F.lit("y")))
    p, r = [t.withColumn("model_id", both) for t in golden_model]
    r = r.withColumn("RISK", F.when(F.col("model_id") == "y", F.col("RISK") * 2).otherwise(F.col("RISK")))
    solution = solve.solve_policy(p, r, by=["model_id"])
    values = {(m, c): v for m, c, v in rows(solution.values)}
    assert values[("y", 0)] == pytest.approx(2 * values[("x", 0)], abs=2e-6)
    terminal = decision.terminal_states(transitions.end_state_dimension(golden[1], 2))
    terminal = terminal.withColumn("model_id", both)
    matrix = decision.policy_matrix(p, solution.policy, terminal, ["model_id"])
    absorbed = absorb.absorption_probabilities(matrix, by=["model_id"])
    assert [r for r in rows(absorbed) if r[0] == "y"] == [
        ("y", 0, 3, 1.0),
        ("y", 1, 3, 1.0),
        ("y", 2, 2, 1.0),
        ("y", 3, 3, 1.0),
    ]


def test_most_likely_transition(golden_model):
    likely = evaluate.most_likely_transition(golden_model[0])
    assert rows(likely) == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 0)]


@pytest.mark.parametrize("options", [{}, {"width": 2}, {"width": 1}, {"lookup_pairs": 0}])
def test_most_likely_path(golden, golden_model, options):
    steps, ends = golden
    predicted = evaluate.most_likely_path(steps, golden_model[0], **options)
    assert rows(predicted) == [("A", 1), ("B", 2), ("C", 0)]
    judged = evaluate.join_truth(predicted, transitions.index_end_states(ends, 2))
    assert rows(evaluate.path_accuracy(judged)) == [(0.333333,)]
    assert rows(evaluate.confusion_matrix(judged)) == [(0, 3, 1), (1, 3, 1), (2, 2, 1)]


@pytest.fixture(scope="module")
def golden_terminal(golden):
    return decision.terminal_states(transitions.end_state_dimension(golden[1], 2))


@pytest.fixture(scope="module")
def golden_policy(spark):
    return spark.createDataFrame([(0, 0), (1, 1)], "CLUSTER int, ACTION int")


def test_policy_matrix_squared(golden_model, golden_policy, golden_terminal):
    matrix = decision.policy_matrix(golden_model[0], golden_policy, golden_terminal)
    twice = decision.chain_steps(matrix, matrix)
    assert rows(twice.where("CLUSTER = 0")) == [
        (0, 0, round(5 / 18, 6)),
        (0, 1, round(1 / 9, 6)),
        (0, 3, round(11 / 18, 6)),
    ]


@pytest.mark.parametrize("options", [{}, {"fold_states": 0}])
def test_absorption(golden_model, golden_policy, golden_terminal, options):
    p = golden_model[0]
    matrix = decision.policy_matrix(p, golden_policy, golden_terminal)
    absorbed = absorb.absorption_probabilities(matrix, **options)
    assert rows(absorbed) == [(0, 3, 1.0), (1, 3, 1.0), (2, 2, 1.0), (3, 3, 1.0)]
    after = decision.absorption_after_action(p, absorbed, golden_terminal)
    assert rows(after.where("ACTION IS NOT NULL")) == [
        (0, 0, 3, 1.0),
        (0, 1, 3, 1.0),
        (1, 0, 2, 1.0),
        (1, 1, 3, 1.0),
    ]
    assert rows(after.where("ACTION IS NULL")) == [(2, None, 2, 1.0), (3, None, 3, 1.0)]


@pytest.mark.parametrize("options", [{}, {"lookup_rows": 0}, {"steps_per_job": 1}])
def test_rollout(golden, golden_model, golden_policy, golden_terminal, options):
    starts = prepare.start_states(golden[0])
    rolled = rollout.policy_rollout(
        starts, golden_model[0], golden_policy, golden_terminal, **options
    )
    assert rows(rolled, "ID", "TIME") == [
        ("A", 0, 0, 0, None),
        ("A", 1, 1, 1, None),
        ("A", 2, 0, 0, None),
        ("A", 3, 3, None, "end_state"),
        ("B", 0, 0, 0, None),
        ("B", 1, 3, None, "end_state"),
        ("C", 0, 1, 1, None),
        ("C", 1, 0, 0, None),
        ("C", 2, 1, 1, None),
        ("C", 3, 3, None, "end_state"),
    ]


@pytest.mark.parametrize("options", [{}, {"lookup_rows": 0}])
def test_rollout_stop_reasons(spark, golden_model, golden_terminal, options):
    starts = spark.createDataFrame(
        [("a", 0), ("b", 1), ("c", 2), ("d", 7)], "ID string, CLUSTER int"
    )
    policy = spark.createDataFrame([(0, 1), (1, 4)], "CLUSTER int, ACTION int")
    rolled = rollout.policy_rollout(
        starts, golden_model[0], policy, golden_terminal, max_steps=1, **options
    )
    assert rows(rolled, "ID", "TIME") == [
        ("a", 0, 0, 1, None),
        ("a", 1, 1, None, "max_steps"),
        ("b", 0, 1, None, "no_transition"),
        ("c", 0, 2, None, "end_state"),
        ("d", 0, 7, None, "no_policy"),
    ]
