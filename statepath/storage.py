"""Cutting lineage with written tables, and joins to small tables.

Tables are written under the shared checkpoint folder, so they survive the loss
of executors and, unlike an RDD checkpoint, keep column pruning, filter pushdown
and true size statistics.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcast only tables of at most this many values (rows x values per row):
# 8 bytes each, so a few tens of MB on every executor at worst.
BROADCAST_VALUES = 1_000_000


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir."""
    context = spark.sparkContext
    root = context.getCheckpointDir()
    if root:
        return root
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if re.fullmatch(r"local(\[.*\])?", context.master) is None:
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="statepath-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/tables/{uuid4().hex}"


# Shuffle files go once the write that made them has ended, not when the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table."""
    spark = df.sparkSession
    path = path or new_path(spark)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, True)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, path: str) -> None:
    """Delete a superseded table written by :func:`materialize`."""
    if not path.startswith(f"{checkpoint_root(spark)}/tables/"):
        raise ValueError(f"not a table of this session: {path}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables that a computation writes and needs no longer than itself.

    ``keep`` writes one; ``drop`` deletes it early, leaving the block deletes the rest.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def keep(self, df: DataFrame) -> DataFrame:
        path = new_path(self._spark)
        table = materialize(df, path)
        self._paths.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table, path in self._paths:
            if any(table is t for t in tables):
                release(self._spark, path)
        self._paths = [(t, p) for t, p in self._paths if not any(t is x for x in tables)]

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*[table for table, _ in self._paths])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows spread by ``keys`` over all shuffle partitions, however few bytes they have.

    For work that is heavy per row: without it adaptive execution would merge
    small partitions and leave most cores idle.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *keys)


def fits_broadcast(table: DataFrame, width: int = 1, limit: int = BROADCAST_VALUES) -> bool:
    """True if a (materialised) table has at most ``limit`` values."""
    return table.count() * width <= limit


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    salt_by: Sequence[str] = ("ID", "TIME"),
    condition: Column | None = None,
    width: int = 1,
    limit: int = BROADCAST_VALUES,
) -> DataFrame:
    """Join many rows to a lookup table whose keys may each own a third of them.

    The lookup is written and counted first. Within ``limit`` values it is
    broadcast, so the rows are never shuffled. Beyond it, the rows are spread
    over ``salt_by`` and the lookup is repeated once per salt, so no key lands
    in one task. ``condition`` is a residual predicate on the joined columns.
    """
    table = materialize(lookup)
    keys = list(on)
    if fits_broadcast(table, width, limit):
        right = F.broadcast(table)
    else:
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
        right = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    right = right.select(
        *[F.col(k).alias(f"_on_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    match = None
    for key in keys:
        equal = F.col(key) == F.col(f"_on_{key}")
        match = equal if match is None else match & equal
    if condition is not None:
        match = match & condition
    joined = rows.join(right, match, how)
    return joined.drop("_salt", *[f"_on_{k}" for k in keys])
