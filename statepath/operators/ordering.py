"""Order-dependent steps that stay distributed when one subject owns most rows.

A window over a subject puts that subject in one task. (ID, TIME) is a key, so
while TIME stays below ``SLICE_WIDTH`` no subject has more rows than that and a
plain window is safe; one scalar, the largest TIME, tells. Beyond it, subjects
are cut into time slices: the window runs inside a slice, and a much smaller
table with one row per (subject, slice) carries what crosses slice borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statepath.config import SLICE_WIDTH

# Rows of one key that a single sorted window may take.
WINDOW_ROWS = 1_000_000


def time_slice(width: int = SLICE_WIDTH) -> Column:
    return F.floor(F.col("TIME") / F.lit(width)).cast("int")


def repeated_key() -> Column:
    """Fails with the (ID, TIME) that a subject has twice."""
    return F.raise_error(
        F.concat(F.lit("two steps of subject "), F.col("ID").cast("string"), F.lit(" at time "), F.col("TIME").cast("string"))
    )


def needs_slices(steps: DataFrame, width: int = SLICE_WIDTH) -> bool:
    latest = steps.agg(F.max("TIME")).first()[0]
    return latest is not None and latest >= width


def number_rows(
    df: DataFrame,
    key: str,
    slice_by: str,
    order_by: Sequence[str],
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``position``: the 0-based rank of a row within ``key``.

    ``slice_by`` must be monotone in ``order_by``; it cuts the work if some key
    has more than ``window_rows`` rows.
    """
    largest = df.groupBy(key).count().agg(F.max("count")).first()[0]
    if largest is None or largest <= window_rows:
        whole = Window.partitionBy(key).orderBy(*order_by)
        return df.withColumn("position", F.row_number().over(whole) - 1)
    earlier = (
        Window.partitionBy(key).orderBy(slice_by).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        df.groupBy(key, slice_by)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .drop("n")
    )
    inside = Window.partitionBy(key, slice_by).orderBy(*order_by)
    numbered = df.withColumn("within", F.row_number().over(inside) - 1)
    return (
        _join_null_safe(numbered, offsets, [key, slice_by])
        .withColumn("position", F.col("before") + F.col("within"))
        .drop("before", "within")
    )


def _join_null_safe(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys of which some may be null on both sides, as a slice without a time is."""
    renamed = table.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys])
    return rows.join(renamed, match, "left").drop(*[f"_on_{k}" for k in keys])


def join_subject(
    steps: DataFrame, subjects: DataFrame, sliced: bool | None = None, width: int = SLICE_WIDTH
) -> DataFrame:
    """Left join a table keyed by ID to steps, without gathering a long subject.

    With slices, the subject row is first repeated once per time slice the
    subject really has, then joined on (ID, slice).
    """
    sliced = needs_slices(steps, width) if sliced is None else sliced
    if not sliced:
        return steps.join(subjects, "ID", "left")
    cut = steps.withColumn("_slice", time_slice(width))
    pairs = cut.select("ID", "_slice").distinct().join(subjects, "ID", "left")
    return _join_null_safe(cut, pairs, ["ID", "_slice"]).drop("_slice")


def lead_values(
    steps: DataFrame,
    following: dict[str, str],
    subjects: DataFrame | None = None,
    at_end: dict[str, str] | None = None,
    sliced: bool | None = None,
    width: int = SLICE_WIDTH,
) -> DataFrame:
    """Add the next observed row's values, falling back to a subject's own value.

    ``following`` maps new column -> column read from the subject's next row by
    TIME (gaps are skipped). ``at_end`` maps new column -> column of ``subjects``
    (one row per ID) used where the next value is null or there is no next row.

    The order must be defined: two rows of a subject at one TIME are an error, which the
    window itself finds.
    """
    sliced = needs_slices(steps, width) if sliced is None else sliced
    at_end = at_end or {}
    sources = sorted(set(following.values()))
    ends = None
    if subjects is not None and at_end:
        ends = subjects.select("ID", *[F.col(c).alias(f"_end_{n}") for n, c in at_end.items()])

    if sliced:
        joined = _lead_by_slice(steps, sources, ends, width)
    else:
        whole = Window.partitionBy("ID").orderBy("TIME")
        joined = steps.withColumns({f"_next_{c}": F.lead(c).over(whole) for c in sources})
        joined = joined.withColumn("_next_time", F.lead("TIME").over(whole))
        joined = joined if ends is None else joined.join(ends, "ID", "left")
    values = []
    for new, source in following.items():
        value = F.col(f"_next_{source}")
        if ends is not None and new in at_end:
            value = F.coalesce(value, F.col(f"_end_{new}"))
        values.append(F.when(F.col("_next_time") == F.col("TIME"), repeated_key()).otherwise(value).alias(new))
    kept = [F.col(c) for c in steps.columns if c not in following]
    return joined.select(*kept, *values)


def _lead_by_slice(
    steps: DataFrame, sources: list[str], ends: DataFrame | None, width: int
) -> DataFrame:
    cut = steps.withColumn("_slice", time_slice(width))
    by_slice = Window.partitionBy("ID").orderBy("_slice")
    first = [F.min_by(c, "TIME").alias(f"_first_{c}") for c in sources]
    heads = cut.groupBy("ID", "_slice").agg(*first)
    heads = heads.select(
        "ID", "_slice", *[F.lead(f"_first_{c}").over(by_slice).alias(f"_after_{c}") for c in sources]
    )
    heads = heads if ends is None else heads.join(ends, "ID", "left")

    inside = Window.partitionBy("ID", "_slice").orderBy("TIME")
    ahead = cut.withColumns({f"_next_{c}": F.lead(c).over(inside) for c in sources})
    ahead = ahead.withColumn("_last", F.lead(F.lit(True)).over(inside).isNull())
    ahead = ahead.withColumn("_next_time", F.lead("TIME").over(inside))
    joined = _join_null_safe(ahead, heads, ["ID", "_slice"])
    crossing = {
        f"_next_{c}": F.when(F.col("_last"), F.col(f"_after_{c}")).otherwise(F.col(f"_next_{c}"))
        for c in sources
    }
    return joined.withColumns(crossing)
