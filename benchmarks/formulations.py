"""Two ways to compute the same result: the customary form and this engine's.

Prints one JSON line per pair. Inputs are tables written before the clock starts.
``COPIES`` repeats the subjects under new IDs, to see how both forms grow. Pairs
can be named as arguments; ``FORMS=ours`` leaves the customary form out.
"""

from __future__ import annotations

import json
import math
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import session  # noqa: E402
from statepath.operators import decision, evaluate, incoherence, prepare, transitions  # noqa: E402
from statepath.plans.rollout import policy_rollout  # noqa: E402
from statepath.storage import materialize  # noqa: E402
from statepath.workload.queries import VECTOR_SIZE, base_steps, event_end_states  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
COPIES = int(os.environ.get("COPIES", "1"))


def two_aggregates_and_a_join(labelled: DataFrame) -> DataFrame:
    keys = ["CLUSTER", "ACTION"]
    known = labelled.where("NEXT_CLUSTER IS NOT NULL")
    counts = known.groupBy(*keys, "NEXT_CLUSTER").agg(F.count("*").alias("cnt"))
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    return counts.join(totals, keys).select(
        *keys, "NEXT_CLUSTER", (F.col("cnt") / F.col("total")).alias("prob")
    )


def five_actions(steps: DataFrame, p: DataFrame, r: DataFrame, ends: DataFrame) -> tuple:
    expected = transitions.expected_next_risk(p, r)
    whole = Window.partitionBy("ID").orderBy("TIME")
    joined = (
        steps.join(expected, ["CLUSTER", "ACTION"], "left")
        .withColumn("lead", F.lead("RISK").over(whole))
        .join(ends.select("ID", "Reward"), "ID", "left")
        .withColumn("y", F.coalesce("lead", "Reward"))
        .withColumn("error", F.abs(F.col("expected_next_risk") - F.col("y")))
    )
    mse = joined.agg(F.avg(F.col("error") ** 2)).first()[0]
    mae = joined.agg(F.avg("error")).first()[0]
    rss = joined.agg(F.sum(F.col("error") ** 2)).first()[0]
    mean = joined.agg(F.avg("y")).first()[0]
    tss = joined.agg(F.sum((F.col("y") - mean) ** 2)).first()[0]
    return mae, mse, 1 - rss / tss


def gathered_vectors(rows: DataFrame) -> DataFrame:
    def radius(vectors):
        size = len(vectors[0])
        mean = [sum(v[i] for v in vectors) / len(vectors) for i in range(size)]
        total = 0.0
        for v in vectors:
            for x, y in zip(v, mean):
                m = (x + y) / 2
                total += 0.5 * (x * math.log(x / m) if x > 0 else 0.0)
                total += 0.5 * (y * math.log(y / m) if y > 0 else 0.0)
        return total / len(vectors)

    gathered = (
        rows.where("NEXT_CLUSTER IS NOT NULL")
        .groupBy("CLUSTER", "ACTION")
        .agg(F.collect_list("prob").alias("vectors"), F.count("*").alias("cnt"))
    )
    return gathered.select(
        "CLUSTER", "ACTION", F.udf(radius, DoubleType())("vectors").alias("incoherence"), "cnt"
    )


def rank_every_row(ends: DataFrame) -> DataFrame:
    rank = F.dense_rank().over(Window.orderBy("end_state")) - 1 + 3
    return ends.select("ID", rank.cast("int").alias("END_INDEX"))


def python_paths(steps: DataFrame, p: DataFrame) -> DataFrame:
    likely = evaluate.most_likely_transition(p).collect()
    table = {(row[0], row[1]): row[2] for row in likely}

    def follow(clusters, actions):
        state = clusters[0]
        for action in actions:
            state = table.get((state, action), state)
        return state

    return evaluate.subject_sequences(steps).select(
        "ID", F.udf(follow, IntegerType())("cluster_seq", "action_seq").alias("end")
    )


def driver_rollout(starts: DataFrame, p: DataFrame, policy: DataFrame, last: int) -> int:
    import numpy as np

    chosen = {row.CLUSTER: row.ACTION for row in policy.collect()}
    moves: dict = {}
    for row in p.collect():
        moves.setdefault((row.CLUSTER, row.ACTION), []).append((row.NEXT_CLUSTER, row.prob))
    visits = 0
    for row in starts.collect():
        draws = np.random.RandomState(42)
        state, step = row.CLUSTER, 0
        while step < 5_000 and state <= last:
            following, probs = zip(*moves[(state, chosen[state])])
            state = draws.choice(following, p=np.array(probs) / sum(probs))
            step += 1
            visits += 1
        visits += 1
    return visits


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    copy = F.explode(F.sequence(F.lit(1), F.lit(COPIES)))
    renamed = F.concat("ID", F.lit("-"), F.col("copy").cast("string"))

    def copied(df):
        return df.withColumn("copy", copy).withColumn("ID", renamed).drop("copy")

    steps = materialize(copied(base_steps(spark, SF_DIR)))
    ends = materialize(copied(event_end_states(spark, SF_DIR)))
    labelled = materialize(transitions.next_state(steps, ends))
    p = materialize(transitions.transition_probabilities(labelled))
    r = materialize(transitions.reward_table(steps, ends))
    total = F.col("k") + F.col("value") + F.col("total_sofa") + 3
    parts = [(F.col(c) + 1) / total for c in ("k", "value", "total_sofa")]
    vectors = materialize(labelled.withColumn("prob", F.array(*parts)))
    values = materialize(r.select("CLUSTER", F.col("RISK").alias("v")))
    q = decision.bellman_backup(decision.attach_reward(p, r), values)
    policy = materialize(decision.best_action(q))
    terminal = materialize(
        decision.terminal_states(transitions.end_state_dimension(ends, 3))
    )
    starts = materialize(prepare.start_states(steps))

    def run(result):
        if isinstance(result, DataFrame):
            result.write.format("noop").mode("overwrite").save()

    pairs = {
        "transition probabilities": (
            lambda: two_aggregates_and_a_join(labelled),
            lambda: transitions.transition_probabilities(labelled),
        ),
        "one-step error": (
            lambda: five_actions(steps, p, r, ends),
            lambda: evaluate.one_step_reward_error(steps, p, r, ends),
        ),
        "information radius": (
            lambda: gathered_vectors(vectors),
            lambda: incoherence.information_radius(vectors, VECTOR_SIZE),
        ),
        "end-state index": (
            lambda: rank_every_row(ends),
            lambda: transitions.index_end_states(ends, 3).select("ID", "END_INDEX"),
        ),
        "most likely path": (
            lambda: python_paths(steps, p),
            lambda: evaluate.most_likely_path(steps, p),
        ),
        "rollout": (
            lambda: driver_rollout(starts, p, policy, 2),
            lambda: policy_rollout(starts, p, policy, terminal),
        ),
    }
    n = steps.count()
    wanted = sys.argv[1:] or list(pairs)
    shown = os.environ.get("FORMS", "customary,ours").split(",")
    for name in wanted:
        result = {"pair": name, "rows": n}
        for kind, form in zip(("customary", "ours"), pairs[name]):
            if kind in shown:
                run(form())
                start = time.perf_counter()
                run(form())
                result[kind] = round(time.perf_counter() - start, 3)
        print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
