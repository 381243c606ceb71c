"""Exact duplicates through an extendible-hash index on shared files.

The 64-bit hash of a text leads through a directory, indexed by the hash's first bits,
to a bucket. A bucket whose texts exceed its capacity splits on its next bit; if it was
as deep as the directory, the directory doubles. The bucket's records are written to
shared files. Owner tasks then take ranges of buckets: records of one hash form a chain,
in which texts are compared byte by byte, so colliding hashes stay apart.

Copies within an Arrow batch are collapsed before they are written, and only records
travel to owners, one per batch and text, so a text that a third of the rows share is no
hot spot. Null counts as an empty text. Ids are integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import attach_few_groups, let_go, set_aside, shared_files, ship_code
from statepath.storage import materialize, new_path

# Bytes of different texts that a bucket holds before it splits.
BUCKET_BYTES = 16 << 20
# Directory of at most 2^24 entries; deeper buckets stay overfull, which is only slower.
MAX_DEPTH = 24
_STEP = 4


@dataclass
class Directory:
    """Buckets in key order and, by the first ``depth`` bits of a hash, their numbers."""

    depth: int = 0
    entries: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    local_depth: dict[int, int] = field(default_factory=lambda: {0: 0})

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        if not self.depth:
            return np.zeros(len(hashes), np.int64)
        return self.entries[hashes.astype(np.uint64) >> np.uint64(64 - self.depth)]

    def split(self, number: int) -> None:
        """Split a bucket on its next bit; the directory doubles if the bucket is as deep."""
        if self.local_depth[number] == self.depth:
            self.entries = np.repeat(self.entries, 2)
            self.depth += 1
        own = np.flatnonzero(self.entries == number)
        new = len(self.local_depth)
        self.entries[own[len(own) // 2 :]] = new
        self.local_depth[number] += 1
        self.local_depth[new] = self.local_depth[number]

    def in_key_order(self) -> Directory:
        """The same buckets, numbered along the key."""
        order, first = np.unique(self.entries, return_index=True)
        rank = np.empty(len(order), np.int64)
        rank[order[np.argsort(first)]] = np.arange(len(order))
        depths = {int(rank[n]): d for n, d in self.local_depth.items()}
        return Directory(self.depth, rank[self.entries], depths)


def build_directory(sizes: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> Directory:
    """Grow a directory for a table of different hashes: (hash, n_bytes).

    Only sums per prefix reach the driver, a few for each bucket.
    """
    directory = Directory()
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    seen = min(MAX_DEPTH, max(1, math.ceil(math.log2(max(2, total / bucket_bytes)))) + 2)
    while True:
        measured = (
            sizes.groupBy(F.shiftrightunsigned("hash", 64 - seen).alias("prefix"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
            .collect()
        )
        bytes_before = np.zeros((1 << seen) + 1)
        hashes_before = np.zeros((1 << seen) + 1)
        for row in measured:
            bytes_before[row.prefix + 1] = row.n_bytes
            hashes_before[row.prefix + 1] = row.n
        bytes_before, hashes_before = np.cumsum(bytes_before), np.cumsum(hashes_before)
        unknown = False
        todo = list(directory.local_depth)
        while todo:
            number = todo.pop()
            first = int(np.argmax(directory.entries == number)) << (seen - directory.depth)
            last = first + (1 << (seen - directory.local_depth[number]))
            many = hashes_before[last] - hashes_before[first] > 1
            if not many or bytes_before[last] - bytes_before[first] <= bucket_bytes:
                continue
            if directory.local_depth[number] == seen:
                unknown = True
                continue
            new = len(directory.local_depth)
            directory.split(number)
            todo += [number, new]
        if not unknown or seen == MAX_DEPTH:
            return directory.in_key_order()
        seen = min(MAX_DEPTH, seen + _STEP)


def _content(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def write_index(docs: DataFrame, directory: Directory, row_id: str, text: str) -> str:
    """Write the records, one per batch and text, into the files of their buckets."""
    spark = docs.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(directory)

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records: dict[str, list] = {}
            columns = (batch.column(c).to_pylist() for c in ("hash", "text", "id"))
            for key, content, own in zip(*columns):
                record = records.setdefault(content, [key, 0, None])
                record[1] += 1
                if own is not None and (record[2] is None or own > record[2]):
                    record[2] = own
            keys, counts, last = zip(*records.values()) if records else ((), (), ())
            keys = np.array(keys, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(shared.value.bucket(keys)),
                    pa.array(keys),
                    pa.array(list(records), pa.string()),
                    pa.array(counts, pa.int64()),
                    pa.array(last, pa.int64()),
                ],
                names=["bucket", "hash", "text", "n", "last_id"],
            )
        let_go()

    keyed = docs.select(
        F.xxhash64(_content(text)).alias("hash"),
        _content(text).alias("text"),
        F.col(row_id).cast("long").alias("id"),
    )
    records = keyed.mapInArrow(collapse, "bucket long, hash long, text string, n long, last_id long")
    path = new_path(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (
        records.repartition(partitions, "bucket")
        .write.partitionBy("bucket")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def own_buckets(path: str, numbers: Iterator[int]) -> Iterator[tuple[str, int, int | None, int]]:
    """(sha-256, size, largest id, place in its chain) of every text in the given buckets."""
    files, root = shared_files(path)
    for number in numbers:
        folder = f"{root}/bucket={number}"
        if files.get_file_info(folder).type == pyarrow.fs.FileType.NotFound:
            continue
        chains: dict[int, list[list]] = {}
        stored = ds.dataset(folder, filesystem=files, format="parquet")
        columns = ["hash", "text", "n", "last_id"]
        for batch in stored.to_batches(columns=columns, batch_size=1024, use_threads=False):
            for key, content, n, last in zip(*(batch.column(c).to_pylist() for c in columns)):
                chain = chains.setdefault(key, [])
                for link in chain:
                    if link[0] == content:
                        link[1] += n
                        if link[2] is None or (last is not None and last > link[2]):
                            link[2] = last
                        break
                else:
                    chain.append([content, n, last])
        for chain in chains.values():
            for place, (content, n, last) in enumerate(chain):
                yield hashlib.sha256(content.encode()).hexdigest(), n, last, place


def copy_groups(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per text that occurs more than once: text_sha256, group_size, keep_id."""
    spark = docs.sparkSession
    sizes = materialize(
        docs.groupBy(F.xxhash64(_content(text)).alias("hash")).agg(
            F.max(F.octet_length(_content(text))).cast("long").alias("n_bytes")
        )
    )
    directory = build_directory(sizes, bucket_bytes)
    path = write_index(docs, directory, row_id, text)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("id").to_pylist()
            found = [g[:3] for g in own_buckets(path, numbers) if g[1] > 1]
            digests, counts, last = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.string()), pa.array(counts, pa.int64()), pa.array(last, pa.int64())],
                names=["text_sha256", "group_size", "keep_id"],
            )
        let_go()

    buckets = len(directory.local_depth)
    owners = spark.range(0, buckets, 1, buckets)
    return owners.mapInArrow(own, "text_sha256 string, group_size long, keep_id long")


def mark_copies(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """``docs`` with text_sha256, group_size, keep_id and kept.

    Of equal texts the row with the largest id stays; rows that repeat its id as well, or
    groups in which no row has an id, are marked kept together. Columns with a result's
    name are replaced.
    """
    groups = materialize(copy_groups(docs, row_id, text, bucket_bytes))
    rows = docs.drop("kept").withColumn("text_sha256", F.sha2(_content(text), 256))
    marked = attach_few_groups(rows, groups, "text_sha256", "group_size", F.col(row_id))
    alone = F.col("group_size").isNull()
    return (
        marked.withColumn("keep_id", F.when(alone, F.col(row_id)).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .withColumn("kept", F.col(row_id).eqNullSafe(F.col("keep_id")))
    )


def remove_copies(
    docs: DataFrame, row_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row of each group of equal texts; other columns of ``docs`` may have any names."""
    hidden, back = set_aside(docs, row_id, text)
    kept = mark_copies(hidden, row_id, text, bucket_bytes).where("kept")
    single = kept.where("group_size = 1")
    several = kept.where("group_size > 1").dropDuplicates(["text_sha256"])
    return back(single.unionByName(several))
