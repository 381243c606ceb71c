"""Absorption probabilities of large sparse processes by eliminating states.

Each round takes a set of states of which no two are neighbours, so that all of them
can be eliminated in the same few joins: a move into such a state becomes moves to
where it leads. Of two neighbours, the one with fewer moves in and out goes first,
which keeps the table of moves sparse. A state's moves are scaled by the sum of its
moves to other states and never by 1 minus its loop; nothing is subtracted, so slow
leaks come out with the precision they are given in. The states then get their
probabilities in reverse order, one join per round.

A chain of n states needs a number of rounds that grows with log n, and no table of
n x n cells arises unless the moves themselves are that many.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.storage import Scratch, join_lookup, materialize

# Where the mass goes that can reach no end; no process numbers a state like this.
NOWHERE = -(2**31)

# Rounds that eliminate less than this share of the states mark the rest as dense.
LEAST_SHARE = 1 / 16


def _is_fixed(matrix: DataFrame, absorbing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moves between different states, and whether each leads to an end."""
    ends = absorbing.select(
        *by, F.col("CLUSTER").alias("NEXT_CLUSTER"), F.lit(True).alias("_is_end")
    )
    moves = matrix.where("CLUSTER <> NEXT_CLUSTER AND prob > 0").join(
        absorbing, [*by, "CLUSTER"], "left_anti"
    )
    marked = join_lookup(
        moves, ends, [*by, "NEXT_CLUSTER"], "left", salt_by=["CLUSTER"], width=len(by) + 2
    )
    fixed = F.coalesce("_is_end", F.lit(False)).alias("fixed")
    return marked.select(*by, "CLUSTER", "NEXT_CLUSTER", "prob", fixed)


def _ranks(moves: DataFrame, by: Sequence[str], number: int) -> DataFrame:
    """Every state on the move, with its place in the order of elimination."""
    out = moves.select(*by, "CLUSTER", F.lit(0).alias("enters"), F.lit(1).alias("leaves"))
    into = moves.where("NOT fixed").select(
        *by, F.col("NEXT_CLUSTER").alias("CLUSTER"), F.lit(1).alias("enters"), F.lit(0).alias("leaves")
    )
    degrees = out.union(into).groupBy(*by, "CLUSTER").agg(
        (F.sum("enters").cast("double") * F.sum("leaves")).alias("fill")
    )
    rank = F.struct("fill", F.xxhash64(F.lit(number), "CLUSTER").alias("draw"), "CLUSTER")
    return degrees.select(*by, "CLUSTER", rank.alias("rank"))


def _chosen(moves: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """States that come before all their neighbours."""
    here = ranks.withColumnRenamed("rank", "rank_here")
    there = ranks.select(*by, F.col("CLUSTER").alias("NEXT_CLUSTER"), F.col("rank").alias("rank_there"))
    between = (
        moves.where("NOT fixed")
        .select(*by, "CLUSTER", "NEXT_CLUSTER")
        .join(here, [*by, "CLUSTER"])
        .join(there, [*by, "NEXT_CLUSTER"])
    )
    later = F.when(F.col("rank_here") < F.col("rank_there"), F.col("NEXT_CLUSTER")).otherwise(
        F.col("CLUSTER")
    )
    behind = between.select(*by, later.alias("CLUSTER")).distinct()
    return ranks.join(behind, [*by, "CLUSTER"], "left_anti").select(*by, "CLUSTER")


def _scaled(moves: DataFrame, states: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moves of ``states``, scaled to 1; those that lead nowhere have one move there."""
    key = [*by, "CLUSTER"]
    totals = moves.groupBy(*key).agg(F.sum("prob").alias("total"))
    return states.join(totals, key, "left").join(moves, key, "left").select(
        *key,
        F.when(F.col("total").isNull(), NOWHERE).otherwise(F.col("NEXT_CLUSTER")).alias("NEXT_CLUSTER"),
        F.when(F.col("total").isNull(), 1.0).otherwise(F.col("prob") / F.col("total")).alias("prob"),
        (F.col("total").isNull() | F.col("fixed")).alias("fixed"),
    )


def _without(moves: DataFrame, gone: DataFrame, by: Sequence[str]) -> DataFrame:
    """The moves of the other states, led past the eliminated ones."""
    key = [*by, "CLUSTER"]
    kept = moves.join(gone, key, "left_anti")
    onward = gone.select(
        *by,
        F.col("CLUSTER").alias("NEXT_CLUSTER"),
        F.col("NEXT_CLUSTER").alias("_to"),
        F.col("prob").alias("_share"),
        F.col("fixed").alias("_fixed"),
    )
    past = kept.where("NOT fixed").join(onward, [*by, "NEXT_CLUSTER"], "left").select(
        *key,
        F.coalesce("_to", "NEXT_CLUSTER").alias("NEXT_CLUSTER"),
        (F.col("prob") * F.coalesce("_share", F.lit(1.0))).alias("prob"),
        F.coalesce("_fixed", "fixed").alias("fixed"),
    )
    return (
        kept.where("fixed")
        .select(*key, "NEXT_CLUSTER", "prob", "fixed")
        .union(past)
        .where("CLUSTER <> NEXT_CLUSTER")
        .groupBy(*key, "NEXT_CLUSTER", "fixed")
        .agg(F.sum("prob").alias("prob"))
        .where("prob > 0")
        .select(*key, "NEXT_CLUSTER", "prob", "fixed")
    )


def _rest(moves: DataFrame, ranks: DataFrame, by: Sequence[str]) -> DataFrame:
    """A whole matrix of the states left and the ends they lead to."""
    left = _scaled(moves, ranks.select(*by, "CLUSTER"), by)
    ends = left.where("fixed").select(*by, F.col("NEXT_CLUSTER").alias("CLUSTER")).distinct()
    loops = ends.select(*by, "CLUSTER", F.col("CLUSTER").alias("NEXT_CLUSTER"), F.lit(1.0).alias("prob"))
    return left.select(*by, "CLUSTER", "NEXT_CLUSTER", "prob").union(loops)


def _backwards(gone: DataFrame, solved: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """Probabilities of one round's states from those of all later ones."""
    key = [*by, "CLUSTER"]
    parts = gone.where(f"fixed AND NEXT_CLUSTER <> {NOWHERE}").select(
        *key, F.col("NEXT_CLUSTER").alias("END_STATE"), "prob"
    )
    if solved is not None:
        later = solved.select(
            *by, F.col("CLUSTER").alias("NEXT_CLUSTER"), "END_STATE", F.col("prob").alias("_later")
        )
        through = gone.where("NOT fixed").join(later, [*by, "NEXT_CLUSTER"])
        parts = parts.union(
            through.select(*key, "END_STATE", (F.col("prob") * F.col("_later")).alias("prob"))
        )
    return parts.groupBy(*key, "END_STATE").agg(F.sum("prob").alias("prob"))


def eliminate_states(
    matrix: DataFrame,
    absorbing: DataFrame,
    by: Sequence[str],
    solve_rest: Callable[[DataFrame], DataFrame],
    few: int,
) -> DataFrame:
    """(CLUSTER, END_STATE, prob) of a valid matrix, written; end states are one-hot.

    ``solve_rest`` solves a smaller matrix: one of at most ``few`` states, or one so dense
    that hardly two states are without a move between them. Mass that reaches no end is
    left out. A state that most others lead to is among the last to go, and moves to ends
    take part in no join on the end.
    """
    spark = matrix.sparkSession
    ones = absorbing.select(*by, "CLUSTER", F.col("CLUSTER").alias("END_STATE"), F.lit(1.0).alias("prob"))
    with Scratch(spark) as kept, Scratch(spark) as turn:
        n_ends = absorbing.count()
        moves = turn.keep(_is_fixed(matrix, absorbing, by))
        gone: list[DataFrame] = []
        rest = None
        while True:
            ranks = turn.keep(_ranks(moves, by, len(gone)))
            n_left = ranks.count()
            if n_left == 0:
                break
            if n_left + n_ends + 1 <= few:
                rest = kept.keep(_rest(moves, ranks, by))
                break
            chosen = turn.keep(_chosen(moves, ranks, by))
            if n_left > 1 / LEAST_SHARE and chosen.count() < n_left * LEAST_SHARE:
                rest = kept.keep(_rest(moves, ranks, by))
                break
            gone.append(kept.keep(_scaled(moves, chosen, by)))
            following = turn.keep(_without(moves, gone[-1], by))
            turn.drop(moves, ranks, chosen)
            moves = following
        solved = None
        if rest is not None:
            columns = [*by, "CLUSTER", "END_STATE", "prob"]
            found = solve_rest(rest).where(f"CLUSTER <> END_STATE AND END_STATE <> {NOWHERE}")
            solved = kept.keep(found.select(*columns))
        for eliminated in reversed(gone):
            new = kept.keep(_backwards(eliminated, solved, by))
            solved = new if solved is None else solved.union(new)
        return materialize(ones if solved is None else ones.union(solved))
