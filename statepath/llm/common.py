"""Helpers the operators share: Arrow batches, shared files, joins to hot groups."""

from __future__ import annotations

import ctypes
import functools
import gc
import math
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statepath.storage import BROADCAST_VALUES, fits_broadcast, materialize

# Text bytes a task works on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
# Bytes of an Arrow batch that Spark hands to a task.
BATCH_BYTES = 8 << 20
# A key counts as hot if it owns more than 1 / HOT_KEYS of the rows, so that there are
# fewer hot keys than this and a list of them can be broadcast.
HOT_KEYS = 1_000
# Rows that a key may have in one task whatever its share.
COLD_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _ship_once(application: str) -> None:
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="statepath-code-")) / "statepath_code.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    SparkSession.active().sparkContext.addPyFile(str(archive))


def ship_code(spark: SparkSession) -> None:
    """Send this package's code (not data) to the executors, once per application."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    _ship_once(spark.sparkContext.applicationId)


def let_go() -> None:
    """Give memory that this process has freed back to the system.

    Python workers outlive tasks and stages, and there can be several for each core.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null counts as empty."""
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(offsets) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``limit`` bytes in ``column``, or one row."""
    content = batch.column(column)
    if pa.types.is_list(content.type):
        lengths = 4 * pc.list_value_length(content).fill_null(0).to_numpy().astype(np.int64)
    else:
        lengths = pc.binary_length(content).fill_null(0).to_numpy()
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def add_columns(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], dict],
    results: dict[str, str],
    text: str,
    without: tuple[str, ...] = (),
    finish: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` with columns computed from slices of its Arrow batches, row by row in order.

    ``results`` maps new columns to their types. A column of ``df`` that has the name of a
    result is replaced; columns in ``without`` are read but not returned. ``finish`` runs
    at the end of a task, to let go of what it remembered: Python workers outlive tasks.
    """
    if text.lower() in {c.lower() for c in results}:
        raise ValueError(f"{text} is a result; rename the input")
    ship_code(df.sparkSession)
    df = df.drop(*[c for c in results if c not in without])
    kept = [c for c in df.columns if c not in without]
    added = T.StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in results.items()))
    schema = T.StructType([*df.select(*kept).schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                found = compute(piece)
                yield pa.RecordBatch.from_arrays(
                    [*[piece.column(c) for c in kept], *[found[c] for c in results]],
                    names=[*kept, *results],
                )
        if finish is not None:
            finish()
        let_go()

    return df.mapInArrow(run, schema)


def set_aside(
    df: DataFrame, *needed: str
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with all but the needed columns under names no operator uses, and the way back."""
    names = {c: f"_aside_{i}" for i, c in enumerate(df.columns) if c not in needed}
    columns = df.columns

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(names.get(c, c)).alias(c) for c in columns])

    return df.withColumnsRenamed(names), back


def text_blocks(items: DataFrame, item_id: str, text: str, limit: int) -> Iterator[list[tuple]]:
    """The items, in blocks of about ``limit`` bytes of text that the driver can hold."""
    items = items.select(item_id, text).where(F.col(text).isNotNull())
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(total / limit))
    for block in range(blocks):
        part = F.pmod(F.xxhash64(text, item_id), F.lit(blocks)) == block
        yield [tuple(row) for row in items.where(part).collect()]


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column in ``taken`` has it in any case."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(starts, ends, document) of every run of word bytes; documents cut runs."""
    flags = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = flags[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = flags[1:]
    starts = np.flatnonzero(flags & ~(before & ~edge[:-1]))
    ends = np.flatnonzero(flags & ~(after & ~edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as asked for."""

    def __init__(self, base: int):
        self._bases = (base, pow(base, -1, 1 << 64))
        self._tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            for i, base in enumerate(self._bases):
                steps = np.full(n + n // 8, base, np.uint64)
                steps[0] = 1
                self._tables[i] = np.cumprod(steps, dtype=np.uint64)
        return self._tables[0][:n], self._tables[1][:n]


def mix(hashes: np.ndarray) -> np.ndarray:
    """Scatter 64-bit hashes so that their top bits depend on all bits."""
    hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(29))


class SpanHash:
    """Hashes of arbitrary spans of a sequence of values, from running sums."""

    def __init__(self, values: np.ndarray, powers: Powers):
        up, self._down = powers(len(values) + 1)
        self._sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def shared_files(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system and path of a folder that driver and executors share."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pyarrow.fs.FileSystem.from_uri(uri)


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    size: str,
    spread_by: Column,
    how: str = "left",
    sizes: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = materialize,
) -> DataFrame:
    """Join ``rows`` to a table with one row per ``key``, some of them very hot.

    A key is hot if it owns more than 1 / HOT_KEYS of the counted rows and COLD_ROWS. Its rows are dealt
    over as many salts as leave each of them less, by a hash of ``spread_by``, and its group
    is repeated for each salt, so no task gathers it. What is broadcast is a list of fewer
    than HOT_KEYS keys and numbers, whatever the groups hold. ``sizes`` are (key, size) if
    ``groups``, then taken as written already, lacks them. ``keep`` writes the groups.
    """
    if sizes is None:
        groups = keep(groups)
        sizes = groups.select(key, size)
    total, most = sizes.agg(F.sum(size), F.max(size)).first()
    limit = max(COLD_ROWS, (total or 0) / HOT_KEYS)
    hot = most is not None and most > limit
    values = [c for c in groups.columns if c != key]
    rows = rows.drop(*values)
    taken = [*rows.columns, *values]
    own, salt, other = (free_name(n, taken) for n in ("_own_key", "_salt", "_group_salt"))
    groups = groups.withColumnRenamed(key, own)
    match = F.col(key) == F.col(own)
    if hot:
        named, salts = (free_name(n, taken) for n in ("_hot_key", "_salts"))
        listed = sizes.where(F.col(size) > limit).select(
            F.col(key).alias(named), F.ceil(F.col(size) / limit).cast("int").alias(salts)
        )
        # as Arrow: rows given as Python objects would start workers of their own
        listed = F.broadcast(rows.sparkSession.createDataFrame(listed.toArrow()))
        rows = rows.join(listed, F.col(key) == F.col(named), "left").withColumn(
            salt, F.coalesce(F.pmod(F.xxhash64(spread_by), F.col(salts)), F.lit(0))
        )
        if size in values:  # without a join, so that the size of small groups stays known
            groups = groups.withColumn(
                other, F.explode(F.sequence(F.lit(0), F.ceil(F.col(size) / limit).cast("int") - 1))
            )
        else:
            groups = groups.join(listed, F.col(own) == F.col(named), "left").withColumn(
                other, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))
            ).drop(named, salts)
        match = match & (F.col(salt) == F.col(other))
        rows = rows.drop(named, salts)
    return rows.join(groups, match, how).drop(salt, own, other)


def attach_few_groups(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    size: str,
    spread_by: Column,
    how: str = "left",
    limit: int = BROADCAST_VALUES,
) -> DataFrame:
    """:func:`attach_groups` for wide rows, most of which have no group.

    Hashes of the keys of ``groups``, written already, are broadcast if there are at most
    ``limit``. Rows whose hash is not among them have no group for certain and pass by the
    join, so they are not shuffled; colliding hashes only cost a row's shuffle.
    """
    sizes = groups.select(key, size)
    if not fits_broadcast(groups, limit=limit):
        return attach_groups(rows, groups, key, size, spread_by, how, sizes)
    values = [c for c in groups.columns if c != key]
    rows = rows.drop(*values)
    hashed = free_name("key_hash", [*rows.columns, *values])
    listed = F.broadcast(groups.select(F.xxhash64(key).alias(hashed)).distinct())
    marked = rows.withColumn(hashed, F.xxhash64(key))
    possible = marked.join(listed, hashed, "left_semi").drop(hashed)
    found = attach_groups(possible, groups, key, size, spread_by, how, sizes)
    if how != "left":
        return found
    others = marked.join(listed, hashed, "left_anti").drop(hashed)
    kinds = {f.name: f.dataType for f in groups.schema}
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in values]
    return found.unionByName(others.select(*rows.columns, *none))


def bounded_sample(rows: DataFrame, label: str, limit: int, order_by: str) -> DataFrame:
    """At most ``limit`` rows of each label, chosen by a hash of ``order_by`` alone.

    A first cut by the hash leaves about twice as many, so that ranking gathers only few.
    """
    sized = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).select(
        F.col(label).alias("_own"), "_n"
    )
    place = F.pmod(F.xxhash64(F.lit(label), F.col(order_by)), F.lit(1 << 40)) / float(1 << 40)
    near = rows.withColumn("_place", place).join(
        F.broadcast(sized), F.col(label) == F.col("_own")
    ).where(F.col("_place") * F.col("_n") <= 2 * limit + 20)
    ranked = Window.partitionBy(label).orderBy("_place", order_by)
    return (
        near.withColumn("_rank", F.row_number().over(ranked))
        .where(F.col("_rank") <= limit)
        .select(*rows.columns)
    )
