"""Refining states until the rows of each (state, action) agree about what follows."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from statepath.config import SLICE_WIDTH, Config
from statepath.operators import forest, incoherence, prepare
from statepath.operators.evaluate import one_step_reward_error
from statepath.operators.transitions import (
    next_state,
    next_state_and_risk,
    reward_table,
    transition_probabilities,
    union_by_name,
)
from statepath.storage import Scratch, materialize, new_path, release

LOG_SCHEMA = (
    "iteration int, cluster int, action int, incoherence double, cnt bigint, "
    "size_0 bigint, size_1 bigint, accepted boolean, new_cluster int, "
    "incoherence_0 double, incoherence_1 double, mae double, mse double, r2 double"
)


class Trained(NamedTuple):
    steps: DataFrame
    transitions: DataFrame
    rewards: DataFrame
    log: DataFrame
    dropped: int


class Candidate(NamedTuple):
    cluster: int
    action: int
    incoherence: float
    cnt: int


def prepare_steps(raw: DataFrame, config: Config) -> DataFrame:
    cleaned = prepare.cast_keys(prepare.clean_steps(raw))
    return prepare.combine_risk(cleaned, config.risk_terms)


def apply_split(
    steps: DataFrame,
    halves: DataFrame,
    cluster: int,
    new_cluster: int,
    end_states: DataFrame,
    bounds: tuple[int, bool] | None = None,
) -> DataFrame:
    """Relabel one half, put the state back with the others, renew NEXT_CLUSTER."""
    relabelled = prepare.conditional_relabel(halves, new_cluster).select(*steps.columns)
    joined = union_by_name(prepare.state_rest(steps, cluster), relabelled)
    return next_state(joined.drop("NEXT_CLUSTER"), end_states, bounds=bounds)


def split_candidate(
    scored: DataFrame, candidate: Candidate, features: list[str], size: int, config: Config
) -> DataFrame:
    """All rows of the candidate's state with SUB."""
    state = scored.where(F.col("CLUSTER") == candidate.cluster)
    chosen = (F.col("ACTION") == candidate.action) & F.col("NEXT_CLUSTER").isNotNull()
    halves = forest.split_state(state.where(chosen), size, config.seed)
    others = state.where(~F.coalesce(chosen, F.lit(False)))
    if others.isEmpty():
        return halves
    return forest.extend_split(
        halves, others, features, size, config.split_trees, config.split_depth, config.seed
    )


def refine_states(
    raw: DataFrame,
    end_states: DataFrame,
    config: Config = Config(),
    features: list[str] | None = None,
) -> Trained:
    """Learn states, P and R from steps and end states.

    Every turn fits a forest, ranks the (state, action) pairs by how much their
    predicted next states disagree, and splits the first pair that yields two
    halves of sufficient size. The source is read once; what else must be known of a
    table comes with its write, by observation. Steps are written once per accepted
    split, and with their predictions once per turn; a turn's tables go with it. The
    driver sees the chosen pair, sizes, incoherences and errors only.

    Two rows of a subject at one TIME are an error, as their order is not defined. The
    log has, for accepted splits, the worst incoherence of each half over its actions
    with at least ``min_splitoff`` labelled rows (null if none has).
    """
    spark = raw.sparkSession
    prepared = prepare_steps(raw, config)
    features = features or prepare.infer_features(prepared)
    inputs = [*features, "ACTION", "RISK"]
    valid = F.coalesce(prepare.is_valid(prepared, inputs), F.lit(False))
    seen = Observation()
    with Scratch(spark) as scratch:
        usable = scratch.keep(
            prepared.observe(
                seen,
                F.count_if(~valid).alias("dropped"),
                F.max(F.when(valid, F.col("TIME"))).alias("latest"),
            ).where(valid)
        )
        dropped, latest = seen.get["dropped"], seen.get["latest"]
        sliced = latest is not None and latest >= SLICE_WIDTH
        start = forest.initial_states(usable, config.initial_states, config.seed)
        known = start.agg(F.max("CLUSTER"), F.countDistinct("CLUSTER")).first()
        next_id, n_states = 0 if known[0] is None else known[0] + 1, known[1]
        path = new_path(spark)
        # the next risk does not change when states are split
        steps = materialize(
            next_state_and_risk(start, end_states, bounds=(next_id, sliced)), path
        )

    log: list[tuple] = []
    tried: set[tuple[int, int]] = set()
    for iteration in range(config.max_states - n_states):
        with Scratch(spark) as turn:
            model = forest.next_state_classifier(
                steps, features, config.forest_trees, config.forest_depth, config.seed
            )
            size = forest.class_count(model)
            scored = turn.keep(forest.next_state_distribution(model, steps))
            ranking = turn.keep(incoherence.information_radius(scored, size))
            accepted = False
            while not accepted:
                best = incoherence.rank_incoherence(ranking, config.min_obs, tried).first()
                if best is None:
                    break
                candidate = Candidate(best.CLUSTER, best.ACTION, best.incoherence, best.cnt)
                tried.add((candidate.cluster, candidate.action))
                counted = Observation()
                halves = turn.keep(
                    split_candidate(scored, candidate, features, size, config).observe(
                        counted, *forest.split_sizes()
                    )
                )
                sizes = (counted.get["size_0"], counted.get["size_1"])
                accepted = min(sizes) >= config.min_splitoff
                worst, error = {}, (None, None, None)
                if accepted:
                    of_halves = incoherence.worst_action(halves, size, min_obs=config.min_splitoff)
                    worst = {r.SUB: r.incoherence for r in of_halves.collect()}
                    previous, path = path, new_path(spark)
                    split = apply_split(
                        steps, halves.drop("prob"), candidate.cluster, next_id, end_states,
                        (next_id + 1, sliced),
                    )
                    steps = materialize(split, path)
                    release(spark, previous)
                    error = one_step_reward_error(
                        steps,
                        transition_probabilities(steps),
                        reward_table(steps, end_states),
                        end_states,
                    ).first()
                new = next_id if accepted else None
                log.append(
                    (iteration, *candidate, *sizes, accepted, new, worst.get(0), worst.get(1), *error)
                )
        if not accepted:
            break
        next_id += 1

    columns = prepare.output_columns(features)
    return Trained(
        prepare.select_existing(steps, columns),
        transition_probabilities(steps),
        reward_table(steps, end_states),
        spark.createDataFrame(log, LOG_SCHEMA),
        dropped,
    )
