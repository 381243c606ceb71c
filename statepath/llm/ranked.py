"""Ranked lexical search: the best documents of all for each item, exactly.

A first pass reduces every document to its length and how often it has each term of the
items; terms of no item cannot score. Collection statistics come from that table.

A second pass searches it in shards that a task holds in memory. Documents of a shard are
clustered by the similarity of their term weights, and every posting list is cut into one
block per cluster. A block keeps the coordinatewise maximum of its documents' weights, so
an item's score with that summary bounds the scores of all of them. An item visits its
lists by falling best weight, and ends where the lists that are left could not reach its
threshold together; of a list it skips the blocks whose bounds fail, and scores the others'
documents. The threshold is the worst of the item's best documents so far, and only what
is below it is skipped, so nothing that belongs to the result is lost.

Only each task's best documents are shuffled, and merged in two steps.
"""

from __future__ import annotations

import math
import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statepath.llm.common import add_columns, ship_code, text_blocks, utf8
from statepath.storage import materialize

BEST = 50
# Item text whose terms are searched in one pass over the documents.
BLOCK_BYTES = 4 << 20
# Documents of a shard, documents per cluster, terms of a group of items, and cells of the
# shard's matrix: a shard takes fewer documents if a group has more terms.
SHARD = 2_048
CLUSTER = 64
GROUP_TERMS = 4_096
CELLS = 8 << 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_CHUNK = 1 << 20


def terms_of(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in parts: a long text is cut between two terms."""
    raw = raw.lower()  # of bytes: A-Z alone
    start = 0
    while start < len(raw):
        end = min(len(raw), start + _CHUNK)
        last = _TERM.match(raw, end - 1) if end < len(raw) else None
        end = last.end() if last else end
        yield _TERM.findall(raw, start, end)
        start = end


@dataclass
class Query:
    """An item: its id and the numbers of its different terms."""

    item: object
    terms: np.ndarray


@dataclass
class Group:
    """Items that are searched together, the terms of them all and which are whose."""

    queries: list[int]
    terms: np.ndarray
    own: list[np.ndarray]
    # columns that some item with the term has
    beside: dict[int, np.ndarray]


def grouped(queries: Sequence[Query], limit: int = GROUP_TERMS) -> list[Group]:
    """Consecutive items with at most ``limit`` different terms, or one item with more."""
    parts: list[tuple[list[int], set[int]]] = []
    for i, query in enumerate(queries):
        new = set(query.terms.tolist())
        if not parts or len(parts[-1][1] | new) > limit:
            parts.append(([], set()))
        parts[-1][0].append(i)
        parts[-1][1].update(new)
    groups = []
    for members, terms in parts:
        ordered = np.array(sorted(terms), np.int64)
        own = [np.searchsorted(ordered, queries[i].terms) for i in members]
        beside: dict[int, set[int]] = {}
        for columns in own:
            for column in columns.tolist():
                beside.setdefault(column, set()).update(columns.tolist())
        groups.append(
            Group(members, ordered, own, {c: np.array(sorted(b)) for c, b in beside.items()})
        )
    return groups


@dataclass
class Best:
    """The best documents of an item so far: (-score, id unknown, id), best first."""

    k: int
    rows: list[tuple] = field(default_factory=list)

    @property
    def threshold(self) -> int:
        """The least score that can enter: an equal one can, by its id."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, score: int, row_id: object) -> None:
        insort(self.rows, (-score, row_id is None, row_id))
        del self.rows[self.k :]


class Shard:
    """Documents of a task with their weights, clustered, and the blocks of their lists.

    ``rows``, ``terms`` and ``weights`` are the entries of the documents' term vectors.
    """

    def __init__(self, n: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, group: Group, value: np.ndarray):
        place = np.searchsorted(group.terms, terms)
        known = place < len(group.terms)
        known[known] = group.terms[place[known]] == terms[known]
        matrix = np.zeros((n, len(group.terms)), np.float32)
        matrix[rows[known], place[known]] = weights[known]
        self.value = value[group.terms].astype(np.float64)
        labels = self._clusters(matrix)
        # row of the matrix to document, cluster by cluster
        self.document = np.argsort(labels, kind="stable")
        self.matrix = matrix[self.document]
        self._labels = labels[self.document]
        columns, members = np.nonzero(self.matrix.T)
        ends = np.searchsorted(columns, np.arange(len(group.terms) + 1))
        self._members, self._ends = members, ends
        self.most = self.matrix.max(axis=0, initial=0).astype(np.float64) * self.value
        self._beside = group.beside
        self._blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _clusters(self, matrix: np.ndarray) -> np.ndarray:
        """The nearest by angle of every ``CLUSTER``-th document for each document."""
        scaled = matrix * self.value.astype(np.float32)
        centres = scaled[::CLUSTER]
        norms = np.sqrt((centres * centres).sum(axis=1))
        return np.argmax(scaled @ (centres / np.maximum(norms, 1)[:, None]).T, axis=1)

    def members(self, column: int) -> np.ndarray:
        return self._members[self._ends[column] : self._ends[column + 1]]

    def blocks(self, column: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the blocks of a list begin, and their summaries over the columns beside it."""
        found = self._blocks.get(column)
        if found is None:
            members = self.members(column)
            labels = self._labels[members]
            starts = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
            rows = self.matrix[members[:, None], self._beside[column]]
            found = self._blocks[column] = starts, np.maximum.reduceat(rows, starts, axis=0)
        return found

    def search(self, own: np.ndarray, best: Best, ids: Sequence) -> tuple[int, int]:
        """Add to ``best`` what belongs there; returns how many blocks were met and skipped."""
        own = own[self.most[own] > 0]
        own = own[np.argsort(-self.most[own], kind="stable")]
        left = np.cumsum(self.most[own][::-1])[::-1]
        value = self.value[own]
        seen = np.zeros(len(self.document), bool)
        met = skipped = 0
        for place, column in enumerate(own.tolist()):
            if left[place] < best.threshold:
                break
            starts, summaries = self.blocks(column)
            bounds = summaries[:, np.searchsorted(self._beside[column], own)] @ value
            members = self.members(column)
            ends = np.append(starts[1:], len(members))
            order = np.argsort(-bounds, kind="stable")
            met += len(order)
            for at, block in enumerate(order.tolist()):
                if bounds[block] < best.threshold:
                    skipped += len(order) - at
                    break
                rows = members[starts[block] : ends[block]]
                rows = rows[~seen[rows]]
                seen[rows] = True
                scores = self.matrix[rows[:, None], own] @ value
                for i in np.flatnonzero(scores >= best.threshold).tolist():
                    if scores[i] >= best.threshold:
                        best.add(int(scores[i]), ids[int(self.document[rows[i]])])
        return met, skipped


@dataclass
class Collection:
    """What scores need to know of all documents; everything is an integer but the logarithm."""

    documents: int
    words: int
    value: np.ndarray  # of each term

    @staticmethod
    def term_value(documents: int, holding: int) -> int:
        return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))

    def weights(self, length: np.ndarray, times: np.ndarray) -> np.ndarray:
        """A term's weight in a document of ``length`` words in which it occurs ``times``."""
        scale = 100 - 50 + (50 * length * self.documents) // self.words
        return (1_000_000_000 * times) // (1_000 * times + 20 * scale)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], row_id: str, text: str) -> DataFrame:
    """(id, n, terms, times): a document's words, and how often it has each known term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def compute(piece: pa.RecordBatch) -> dict:
        known = shared.value
        data, offsets = utf8(piece.column(text))
        raw = data.tobytes()
        lengths, terms, times = [], [], []
        for i in range(piece.num_rows):
            n, found = 0, Counter()
            for part in terms_of(raw[offsets[i] : offsets[i + 1]]):
                n += len(part)
                found.update(map(known.get, part))
            found.pop(None, None)
            ordered = sorted(found)
            lengths.append(n)
            terms.append(ordered)
            times.append([found[t] for t in ordered])
        return {
            "n": pa.array(lengths, pa.int64()),
            "terms": pa.array(terms, pa.list_(pa.int32())),
            "times": pa.array(times, pa.list_(pa.int32())),
        }

    results = {"n": "long", "terms": "array<int>", "times": "array<int>"}
    inputs = docs.select(F.col(row_id).alias("id"), F.col(text).alias("content"))
    text = "content"
    return add_columns(inputs, compute, results, text, (text,))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes


def _search(counted: DataFrame, queries: list[Query], collection: Collection, k: int) -> DataFrame:
    """(item, id, score): the best documents of each item in each task."""
    spark = counted.sparkSession
    ship_code(spark)
    groups = grouped(queries)
    widest = max(len(g.terms) for g in groups)
    size = max(1, min(SHARD, CELLS // widest))
    shared = spark.sparkContext.broadcast((groups, collection))

    def search(best: list[Best], table: pa.Table) -> None:
        groups, collection = shared.value
        terms, sizes = _flat(table.column("terms"))
        times, _ = _flat(table.column("times"))
        rows = np.repeat(np.arange(len(sizes)), sizes)
        lengths = table.column("n").to_numpy()[rows]
        weights = collection.weights(lengths, times)
        ids = table.column("id").to_pylist()
        for group in groups:
            shard = Shard(len(sizes), rows, terms, weights, group, collection.value)
            for query, own in zip(group.queries, group.own):
                shard.search(own, best[query], ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries]
        kind, waiting, n = None, [], 0
        for batch in batches:
            kind = batch.schema.field("id").type
            while batch.num_rows:
                part = batch.slice(0, size - n)
                batch = batch.slice(len(part))
                waiting.append(part)
                n += len(part)
                if n == size:
                    search(best, pa.Table.from_batches(waiting))
                    waiting, n = [], 0
        if waiting:
            search(best, pa.Table.from_batches(waiting))
        if kind is not None:
            found = [(i, row) for i, own in enumerate(best) for row in own.rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([i for i, _ in found], pa.int32()),
                    pa.array([row[2] for _, row in found], kind),
                    pa.array([-row[0] for _, row in found], pa.int64()),
                ],
                names=["item", "id", "score"],
            )

    kind = counted.schema["id"].dataType.simpleString()
    return counted.select("id", "n", "terms", "times").mapInArrow(
        run, f"item int, id {kind}, score long"
    )


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of each item: first in each of many parts, then of what these leave."""
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    salted = found.withColumn("part", F.pmod(F.xxhash64("id", "score"), F.lit(parts)))
    for keys in (["item", "part"], ["item"]):
        ranked = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        salted = salted.withColumn("rank", ranked).where(F.col("rank") <= k)
    return salted.drop("part")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = BEST,
    row_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, row_id, score): for each item its ``k`` best documents, best first.

    Terms are runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null
    has none, and documents or items without terms are in no result. Only scores above 0
    count; equal ones go by ascending ``row_id``, null last. A repeated item is ranked as
    often as it occurs, repeated documents are ranked each. Other columns of either table
    have no part in this, whatever their names, and are not returned. Items beyond one
    block are searched block by block.
    """
    spark = docs.sparkSession
    total = None
    for block in text_blocks(items, item_id, item_text, block_bytes):
        vocabulary: dict[bytes, int] = {}
        queries = []
        for item, content in block:
            own = {t for part in terms_of(content.encode()) for t in part}
            if own:
                numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in sorted(own)]
                queries.append(Query(item, np.array(sorted(numbers), np.int64)))
        if not queries:
            continue
        counted = materialize(count_terms(docs, vocabulary, row_id, text))
        sums = counted.agg(F.count_if(F.col("n") > 0).alias("n"), F.sum("n").alias("words")).first()
        if not sums.n:
            break
        holding = np.zeros(len(vocabulary), np.int64)
        of_terms = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
        for row in of_terms.collect():  # no more than the items have terms
            holding[row.term] = row["count"]
        value = np.array([Collection.term_value(sums.n, int(h)) for h in holding], np.int64)
        found = _merged(_search(counted, queries, Collection(sums.n, sums.words, value), k), k)
        names = spark.createDataFrame(
            [(i, q.item) for i, q in enumerate(queries)],
            f"item int, name {items.schema[item_id].dataType.simpleString()}",
        )
        named = materialize(found.join(F.broadcast(names), "item"))
        total = named if total is None else total.unionByName(named)
    if total is None:
        total = spark.createDataFrame(
            [],
            f"item int, name {items.schema[item_id].dataType.simpleString()}, rank int, "
            f"id {docs.schema[row_id].dataType.simpleString()}, score long",
        )
    return total.select(
        F.col("name").alias(item_id), "rank", F.col("id").alias(row_id), "score"
    )
