"""Rolling subjects forward under a policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.functions import portable_uniform
from statepath.operators.decision import cumulative_transitions, policy_transitions
from statepath.storage import fits_broadcast, join_lookup, materialize, new_path, spread

# The policy's transitions are held as one map value per task up to this many
# rows of P; beyond it each step is a join.
LOOKUP_ROWS = 10_000

PATH_TYPE = "array<struct<TIME:int,CLUSTER:int,ACTION:int>>"


def policy_moves(
    intervals: DataFrame, policy: DataFrame, terminal: DataFrame
) -> DataFrame:
    """What happens in each known state: (CLUSTER, ends, ACTION, upper, following).

    ``upper`` and ``following`` are the interval ends and next states, ascending;
    null if the policy's action was never observed in the state.
    """
    step = F.struct("hi", "NEXT_CLUSTER")
    observed = (
        policy_transitions(intervals, policy)
        .groupBy("CLUSTER", "ACTION")
        .agg(F.array_sort(F.collect_list(step)).alias("steps"))
    )
    acting = (
        policy.select("CLUSTER", "ACTION")
        .join(terminal, "CLUSTER", "left_anti")
        .join(observed, ["CLUSTER", "ACTION"], "left")
        .select(
            "CLUSTER",
            F.lit(False).alias("ends"),
            F.col("ACTION").cast("int").alias("ACTION"),
            F.col("steps.hi").alias("upper"),
            F.col("steps.NEXT_CLUSTER").alias("following"),
        )
    )
    ended = terminal.select("CLUSTER", F.lit(True).alias("ends"))
    return acting.unionByName(ended, allowMissingColumns=True)


def _verdict(move, time, max_steps):
    """Why a subject stops in a state; null if it goes on."""
    return (
        F.when(move["ends"], F.lit("end_state"))
        .when(time >= max_steps, F.lit("max_steps"))
        .when(move["ACTION"].isNull(), F.lit("no_policy"))
        .when(move["upper"].isNull(), F.lit("no_transition"))
    )


def _visit(time, state, action):
    return F.array(F.struct(time.alias("TIME"), state.alias("CLUSTER"), action.alias("ACTION")))


def _advance_by_map(frontier, moves, max_steps, seed, steps):
    """Up to ``steps`` steps of every subject in one narrow pass, without a join."""
    entry = F.struct("CLUSTER", F.struct("ends", "ACTION", "upper", "following"))
    table = moves.agg(F.map_from_entries(F.collect_list(entry))).scalar()

    def moved(at, move, u):
        stop = _verdict(move, at["TIME"], max_steps)
        place = F.size(F.filter(move["upper"], lambda hi: hi <= u)) + 1
        return F.struct(
            F.when(stop.isNull(), at["TIME"] + 1).otherwise(at["TIME"]).alias("TIME"),
            F.when(stop.isNull(), F.try_element_at(move["following"], place))
            .otherwise(at["CLUSTER"])
            .alias("CLUSTER"),
            stop.alias("stop_reason"),
            F.concat(
                at["path"],
                _visit(at["TIME"], at["CLUSTER"], F.when(stop.isNull(), move["ACTION"])),
            ).alias("path"),
        )

    def step(at, _):
        # the lookup and the draw are bound once, not once per use
        move = F.try_element_at(F.col("moves"), at["CLUSTER"])
        u = portable_uniform(seed, F.col("ID"), at["TIME"])
        drawn = F.struct(move.alias("move"), u.alias("u"))
        bound = F.transform(F.array(drawn), lambda d: moved(at, d["move"], d["u"]))
        return F.when(at["stop_reason"].isNotNull(), at).otherwise(F.get(bound, F.lit(0)))

    start = F.struct(
        F.col("TIME"),
        F.col("CLUSTER"),
        F.lit(None).cast("string").alias("stop_reason"),
        F.array().cast(PATH_TYPE).alias("path"),
    )
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return (
        frontier.withColumn("moves", table)
        .select("ID", folded.alias("at"))
        .select("ID", "at.*")
    )


def _advance_by_join(frontier, moves, max_steps, seed, limit):
    """One step of every subject by a join to the policy's moves."""
    known = join_lookup(
        frontier, moves, ["CLUSTER"], "left", salt_by=["ID"], width=8, limit=limit
    )
    known = known.withColumn("move", F.struct("ends", "ACTION", "upper", "following"))
    stop = _verdict(F.col("move"), F.col("TIME"), max_steps)
    u = portable_uniform(seed, F.col("ID"), F.col("TIME"))
    known = known.withColumns({"stop_reason": stop, "u": u})
    place = F.size(F.filter("upper", lambda hi: hi <= F.col("u"))) + 1
    goes_on = F.col("stop_reason").isNull()
    return known.select(
        "ID",
        F.when(goes_on, F.col("TIME") + 1).otherwise(F.col("TIME")).alias("TIME"),
        F.when(goes_on, F.try_element_at("following", place))
        .otherwise(F.col("CLUSTER"))
        .alias("CLUSTER"),
        "stop_reason",
        _visit(F.col("TIME"), F.col("CLUSTER"), F.when(goes_on, F.col("ACTION")))
        .cast(PATH_TYPE)
        .alias("path"),
    )


def policy_rollout(
    starts: DataFrame,
    transitions: DataFrame,
    policy: DataFrame,
    terminal: DataFrame,
    max_steps: int = 5_000,
    seed: int = 42,
    steps_per_job: int = 250,
    lookup_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """(ID, TIME, CLUSTER, ACTION, stop_reason) until every subject has stopped.

    ``starts`` is (ID, CLUSTER). The last row of a subject has a null ACTION and
    says why it stopped; the others have no stop_reason. All subjects move
    together, ``steps_per_job`` steps per job, and those that stopped leave the
    frontier. Draws depend on (seed, ID, TIME) alone.
    """
    spark = starts.sparkSession
    intervals = cumulative_transitions(transitions)
    moves = materialize(policy_moves(intervals, policy, terminal))
    folds = fits_broadcast(moves.select(F.explode_outer("upper")), limit=lookup_rows)
    # blocks are written with this many files, so later blocks keep the parallelism
    frontier = spread(starts, "ID").select(
        F.col("ID").cast("string").alias("ID"),
        F.lit(0).alias("TIME"),
        F.col("CLUSTER").cast("int").alias("CLUSTER"),
    )
    root = new_path(spark)
    schema = None
    block = 0
    while True:
        if folds:
            moved = _advance_by_map(frontier, moves, max_steps, seed, steps_per_job)
        else:
            moved = _advance_by_join(frontier, moves, max_steps, seed, lookup_rows)
        schema = schema or moved.schema
        written = materialize(moved, f"{root}/block={block}")
        frontier = written.where("stop_reason IS NULL").select("ID", "TIME", "CLUSTER")
        block += 1
        if frontier.isEmpty():
            break
    visits = spark.read.schema(schema).option("basePath", root).parquet(root)
    last = F.col("visit.ACTION").isNull()
    return visits.select("ID", "stop_reason", F.explode("path").alias("visit")).select(
        "ID",
        "visit.TIME",
        "visit.CLUSTER",
        "visit.ACTION",
        F.when(last, F.col("stop_reason")).alias("stop_reason"),
    )
