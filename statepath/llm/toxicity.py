"""Toxic spans by a linear-chain conditional random field.

Labels say which documents are toxic, not which words. Seed features (a word, its first
3 to 6 bytes or its last 3) are those that occur almost only in toxic documents, and in
more of them than chance explains. Words with a seed feature in a toxic document are
labelled toxic, all words of clean documents are not, and the field learns from these
labelled words; its features are those of the word and the labels of its neighbours. A
second round takes the words that the first field marks in toxic documents as labels.

Forward-backward gives every word its marginal. The largest one of a document, put
through a logistic curve fitted on the same documents, is its score; runs of words with a
marginal of at least one half are its spans.

Sequences are documents cut every SEGMENT words. Everything is learned from a bounded
sample of labelled documents, whole texts, that the driver holds; scoring is per row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import Powers, SpanHash, add_columns, bounded_sample, mix, utf8, words_of

# Labelled documents that are learned from, for each label.
LEARN_TOXIC = 1_000
LEARN_CLEAN = 3_500
# Clean documents among them whose words train the field.
TRAIN_CLEAN = 1_000
SEGMENT = 64
FEATURE_BITS = 21
FEATURES = 1 << FEATURE_BITS
_PREFIXES = (6, 5, 4, 3)
_SUFFIX = 3
N_KINDS = 2 + len(_PREFIXES)
# A seed is at least this many times as frequent in toxic as in clean documents.
SEED_RATIO = 50
LEAST_COVER = 3
_EPOCHS = 4
_BATCH = 512
_LIMIT = 30.0

_BYTES = np.arange(256)
_UPPER = (_BYTES >= ord("A")) & (_BYTES <= ord("Z"))
_LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
_IS_WORD = (
    ((_BYTES >= ord("0")) & (_BYTES <= ord("9")))
    | ((_LOWER >= ord("a")) & (_LOWER <= ord("z")))
    | (_BYTES >= 0x80)
)
_VALUES = mix(_LOWER.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
_POWERS = Powers(0x5851F42D4C957F2D)
SPANS = "array<struct<start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Words:
    """The words of a batch of texts: places, text numbers and feature numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.text = words_of(data, offsets, _IS_WORD)
        hashed = SpanHash(_VALUES[data], _POWERS)
        kinds = [self._number(hashed(self.starts, self.ends), 0)]
        sizes = self.ends - self.starts
        for kind, length in enumerate(_PREFIXES, 1):
            stop = np.minimum(self.starts + length, self.ends)
            kinds.append(self._number(hashed(self.starts, stop), kind, sizes >= length))
        start = np.maximum(self.ends - _SUFFIX, self.starts)
        kinds.append(self._number(hashed(start, self.ends), N_KINDS - 1, sizes >= _SUFFIX))
        self.features = np.stack(kinds, axis=1)

    @staticmethod
    def _number(hashes: np.ndarray, kind: int, exists: np.ndarray | None = None) -> np.ndarray:
        """Features from 1 on; 0 where a word is too short for the feature."""
        salted = mix(hashes ^ np.uint64((kind + 1) * 0x2545F4914F6CDD1D & (1 << 64) - 1))
        numbers = (salted >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        numbers = np.maximum(numbers, 1)
        return numbers if exists is None else np.where(exists, numbers, 0)


def segments(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(segment, place in it, number of segments) of each word, from its text number."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    new_text = np.ones(n, bool)
    new_text[1:] = text[1:] != text[:-1]
    rank = np.arange(n) - np.maximum.accumulate(np.where(new_text, np.arange(n), 0))
    segment = np.cumsum(rank % SEGMENT == 0) - 1
    return segment, rank % SEGMENT, int(segment[-1]) + 1


@dataclass
class Field:
    """Weights of the two-label chain: of features for label 1, of label pairs, of starts."""

    weights: np.ndarray
    bias: float
    pairs: np.ndarray  # 2 x 2
    start: np.ndarray  # 2

    def emissions(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features].sum(axis=1, dtype=np.float64) + self.bias

    def posteriors(self, emission: np.ndarray, filled: np.ndarray, with_pairs: bool = False):
        """Marginals of label 1 for padded segments, and summed marginals of label pairs."""
        rows, width = emission.shape
        own = np.ones((rows, width, 2))
        own[:, :, 1] = np.exp(np.clip(emission, -_LIMIT, _LIMIT))
        step = np.exp(self.pairs)
        forward = np.empty((width, rows, 2))
        now = own[:, 0] * np.exp(self.start)
        forward[0] = now / now.sum(axis=1, keepdims=True)
        for t in range(1, width):
            now = (forward[t - 1] @ step) * own[:, t]
            forward[t] = now / now.sum(axis=1, keepdims=True)
        backward = np.ones((width, rows, 2))
        pair_sums = np.zeros((2, 2))
        for t in range(width - 2, -1, -1):
            later = own[:, t + 1] * backward[t + 1]
            now = later @ step.T
            now /= now.sum(axis=1, keepdims=True)
            inside = filled[:, t + 1 : t + 2]
            backward[t] = np.where(inside, now, 1.0)
            if with_pairs:
                joint = forward[t][:, :, None] * step * later[:, None, :]
                joint /= joint.sum(axis=(1, 2), keepdims=True)
                pair_sums += joint[filled[:, t + 1]].sum(axis=0)
        both = forward * backward
        marginals = (both[:, :, 1] / both.sum(axis=2)).T
        return (marginals, pair_sums) if with_pairs else marginals

    def marginals(self, words: Words) -> np.ndarray:
        """The marginal of label 1 of every word."""
        segment, place, n = segments(words.text)
        found = np.zeros(len(segment))
        emission = self.emissions(words.features)
        block = 4096  # segments at once
        edges = np.searchsorted(segment, np.arange(0, n + block, block))
        for low, high in zip(edges[:-1], edges[1:]):
            if low == high:
                continue
            at = segment[low:high] - segment[low], place[low:high]
            padded = np.zeros((at[0][-1] + 1, SEGMENT))
            filled = np.zeros(padded.shape, bool)
            padded[at], filled[at] = emission[low:high], True
            found[low:high] = self.posteriors(padded, filled)[at]
        return found


def choose_seeds(toxic: list[np.ndarray], clean_count: np.ndarray, n_clean: int) -> np.ndarray:
    """Seed features: a boolean per feature.

    ``toxic`` has the distinct features of each toxic document, ``clean_count`` in how
    many of ``n_clean`` clean documents each feature occurs. A seed occurs in more toxic
    documents than chance would give any of the features tried.
    """
    cover = np.bincount(np.concatenate(toxic), minlength=FEATURES)
    ratio = (cover / len(toxic)) / ((clean_count + 0.5) / (n_clean + 1))
    chance = len(toxic) / (len(toxic) + n_clean + 1)
    most_first = np.sort(cover + clean_count)[::-1]
    least = LEAST_COVER
    while np.count_nonzero(most_first >= least) * chance**least > 0.1:
        least += 1
    seeds = (cover >= least) & ((ratio >= SEED_RATIO) | (clean_count == 0))
    seeds[0] = False
    return seeds


def unlike(features: np.ndarray, seen: set) -> bool:
    """False if a document with these features is nearly a copy of an earlier one.

    Compares four bands of three minimal hashes of its words. Copies would make every
    word that they share look like a cause of their label.
    """
    words = features[:, 0].astype(np.uint64)
    if not len(words):
        return False
    salts = np.arange(1, 13, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = mix(words[:, None] * np.uint64(0xD1B54A32D192ED03) ^ salts).min(axis=0).reshape(4, 3)
    bands = {(i, *row.tolist()) for i, row in enumerate(least)}
    new = seen.isdisjoint(bands)
    seen |= bands
    return new


def train(features: np.ndarray, labels: np.ndarray, text: np.ndarray, seed: int = 0) -> Field:
    """Fit a field to labelled words by AdaGrad on the conditional likelihood."""
    field = Field(np.zeros(FEATURES, np.float32), -3.0, np.zeros((2, 2)), np.zeros(2))
    segment, place, n = segments(text)
    bounds = np.searchsorted(segment, np.arange(n + 1))
    squares = np.full(FEATURES, 1e-3, np.float32)
    squares_bias, squares_pairs, squares_start = 1e-3, np.full((2, 2), 1e-3), np.full(2, 1e-3)
    order = np.random.default_rng(seed)
    rate = 0.5
    for _ in range(_EPOCHS):
        shuffled = order.permutation(n)
        for low in range(0, n, _BATCH):
            chosen = shuffled[low : low + _BATCH]
            sizes = bounds[chosen + 1] - bounds[chosen]
            ends = np.cumsum(sizes)
            words = np.arange(ends[-1]) + np.repeat(bounds[chosen] - ends + sizes, sizes)
            at = np.repeat(np.arange(len(chosen)), sizes), place[words]
            emission = np.zeros((len(chosen), SEGMENT))
            filled = np.zeros(emission.shape, bool)
            truth = np.zeros(emission.shape, np.int64)
            emission[at], filled[at] = field.emissions(features[words]), True
            truth[at] = labels[words]
            marginals, pair_sums = field.posteriors(emission, filled, with_pairs=True)
            error = (truth - marginals)[at] / len(chosen)
            touched, inverse = np.unique(features[words], return_inverse=True)
            gradient = np.bincount(inverse.ravel(), np.repeat(error, N_KINDS), len(touched))
            gradient -= 1e-4 * field.weights[touched] / len(chosen)
            gradient[touched == 0] = 0
            squares[touched] += gradient**2
            field.weights[touched] += rate * gradient / np.sqrt(squares[touched])
            squares_bias += error.sum() ** 2
            field.bias += rate * error.sum() / math.sqrt(squares_bias)
            both = filled[:, 1:]
            seen = np.bincount((truth[:, :-1] * 2 + truth[:, 1:])[both], minlength=4).reshape(2, 2)
            change = (seen - pair_sums) / len(chosen)
            squares_pairs += change**2
            field.pairs += rate * change / np.sqrt(squares_pairs)
            first = np.array([-1.0, 1.0]) * (truth[:, 0] - marginals[:, 0]).sum() / len(chosen)
            squares_start += first**2
            field.start += rate * first / np.sqrt(squares_start)
    return field


@dataclass
class Model:
    field: Field | None
    slope: float
    offset: float

    def scores(self, largest: np.ndarray) -> np.ndarray:
        """Document scores from the largest marginals; without a field all get the same."""
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(largest) + self.offset, -500, 500)))


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve by Newton steps, slightly regularised."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (y - p) - 0.1 * beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        change = np.linalg.solve(hessian, gradient)
        beta += np.clip(change, -2, 2)
        if np.abs(change).max() < 1e-6:
            break
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(documents: list[tuple[str, int]]) -> Model:
    """Learn from (text, label) pairs, in the given order."""
    toxic, clean_count = [], np.zeros(FEATURES, np.int64)
    kept: list[tuple[Words, int]] = []
    n_clean = 0
    seen: set = set()
    for text, label in documents:
        raw = np.frombuffer(text.encode(), np.uint8)
        words = Words(raw, np.array([0, len(raw)]))
        if not unlike(words.features, seen):
            continue
        distinct = np.unique(words.features)
        if label:
            toxic.append(distinct)
        else:
            clean_count[distinct] += 1
            n_clean += 1
        if label or n_clean <= TRAIN_CLEAN:
            kept.append((words, label))
    if not toxic or not n_clean:
        prior = 0.0 if not toxic else 1.0
        return Model(None, 0.0, 20.0 if prior else -20.0)
    seeds = choose_seeds(toxic, clean_count, n_clean)
    field = None
    for _ in range(2):
        features, labels, number = [], [], []
        for i, (words, label) in enumerate(kept):
            if not len(words.text):
                continue
            if not label:
                own = np.zeros(len(words.text), np.int64)
            elif field is None:
                own = seeds[words.features].any(axis=1).astype(np.int64)
            else:
                own = (field.marginals(words) >= 0.5).astype(np.int64)
            if label and not own.any():
                continue  # which of its words are toxic is unknown
            features.append(words.features)
            labels.append(own)
            number.append(np.full(len(own), i))
        if not any(x.any() for x in labels):
            break
        field = train(np.concatenate(features), np.concatenate(labels), np.concatenate(number))
    if field is None:
        share = len(toxic) / (len(toxic) + n_clean)
        return Model(None, 0.0, math.log(share / (1 - share)))
    largest = np.array([field.marginals(w).max(initial=0.0) for w, _ in kept])
    truth = np.array([y for _, y in kept], float)
    return Model(field, *fit_curve(_logit(largest), truth))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    toxic_limit: int = LEARN_TOXIC,
    clean_limit: int = LEARN_CLEAN,
) -> Model:
    """Learn from at most so many labelled documents, chosen by a hash of their ids.

    A document with several labels is toxic if one says so; null labels count as none.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull())
        .groupBy(row_id)
        .agg(F.max(label).alias("_label"))
    )
    chosen = bounded_sample(known.where("_label = 1"), "_label", toxic_limit, row_id).union(
        bounded_sample(known.where("_label = 0"), "_label", clean_limit, row_id)
    ).select(F.col(row_id).alias("_id"), "_label")
    sample = (
        docs.select(row_id, text)
        .join(F.broadcast(chosen), F.col(row_id) == F.col("_id"))
        .select(text, "_label")
        .where(F.length(text) > 0)
        .distinct()
        .orderBy(F.xxhash64(text), text, "_label")
    )
    return fit([(row[0], int(row[1])) for row in sample.collect()])


def score(
    docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True, with_spans: bool = True
) -> DataFrame:
    """``docs`` with score, predicted (1 if score >= 0.5) and toxic_spans.

    Spans are character offsets. A null or empty text has the score of a text whose words
    are certainly clean. Columns with a result's name are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = {"score": "double", "predicted": "int"} | ({"toxic_spans": SPANS} if with_spans else {})

    def run(piece: pa.RecordBatch) -> dict:
        model = shared.value
        data, offsets = utf8(piece.column(text))
        n = piece.num_rows
        largest = np.zeros(n)
        spans = [[] for _ in range(n)]
        if model.field is not None:
            words = Words(data, offsets)
            found = model.field.marginals(words)
            np.maximum.at(largest, words.text, found)
            marked = np.flatnonzero(found >= 0.5)
            for i in np.unique(words.text[marked]) if with_spans else ():
                own = marked[words.text[marked] == i]
                spans[i] = _spans(own, words, data[offsets[i] : offsets[i + 1]], offsets[i])
        scores = model.scores(largest)
        return {
            "score": pa.array(scores, pa.float64()),
            "predicted": pa.array((scores >= 0.5).astype(np.int32)),
            "toxic_spans": pa.array(spans, _SPAN_TYPE),
        }

    return add_columns(docs, run, results, text, () if keep_text else (text,))


def _spans(own: np.ndarray, words: Words, raw: np.ndarray, base: int) -> list[dict]:
    """Character offsets of the runs of marked words in one text."""
    characters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    breaks = np.flatnonzero(np.diff(own) > 1)
    heads = own[np.concatenate([[0], breaks + 1])]
    tails = own[np.concatenate([breaks, [len(own) - 1]])]
    starts = characters[words.starts[heads] - base]
    ends = characters[words.ends[tails] - base]
    return [{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)]
