"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from statepath.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_ranks(docs, items, k):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_words = sum(sum(c.values()) for _, c in counts)
    holding = Counter(t for _, c in counts for t in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            score = 0
            for term in set(plain_terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[term] + 1)))
                m = 50 + (50 * sum(c.values()) * n_docs) // n_words
                score += w * ((1_000_000_000 * c[term]) // (1000 * c[term] + 20 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        scored.sort()
        found += [(item, r + 1, doc, -s) for r, (s, _, doc) in enumerate(scored[:k])]
    return sorted(found, key=str)


def corpus(n, seed=1):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "straße", "x1", "THE"]
    topics = [[draw.choice(vocabulary) for _ in range(40)] for _ in range(12)]
    docs = []
    for i in range(n):
        topic = draw.choice(topics)
        docs.append((i, " ".join(draw.choice(topic if draw.random() < 0.7 else vocabulary) for _ in range(draw.randrange(1, 80)))))
    docs += [(n + i, docs[3][1]) for i in range(60)]  # more equal scores than places
    docs += [(9_000, None), (9_001, ""), (9_002, " .,- "), (None, docs[5][1]), (7, "w1 w1 again"), (9_003, "w2 " * 60_000)]
    items = [(i, " ".join(draw.choices(topic, k=9))) for i, topic in enumerate(topics)]
    items += [(50, None), (51, "..."), (52, docs[3][1]), (53, "nowhere at all"), (0, "w1 the STRASSE straße"), (54, "ünï Ünï")]
    return docs, items


@pytest.mark.parametrize(("block_bytes", "k"), [(4 << 20, 50), (400, 3)])
def test_ranks_equal_brute_force_with_ties_and_awkward_rows(spark, block_bytes, k):
    docs, items = corpus(700)
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, item string, n int")
    wanted = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    found = ranked.rank_documents(frame.repartition(3), wanted, k, block_bytes=block_bytes)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_ranks(docs, items, k)


def test_no_documents_no_items_no_terms(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, None)], "item_id long, text string")
    for d, i in ((docs, items), (docs.where("false"), items), (docs, items.where("false"))):
        found = ranked.rank_documents(d, i)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_blocks_are_skipped_and_nothing_is_lost():
    docs, items = corpus(3_000, seed=4)
    vocabulary, queries = {}, []
    for item, text in items:
        own = sorted({t for part in ranked.terms_of((text or "").encode()) for t in part})
        queries.append(ranked.Query(item, np.array(sorted(vocabulary.setdefault(t, len(vocabulary)) for t in own), np.int64)))
    draw = np.random.default_rng(3)
    value = draw.integers(1, 9_000, len(vocabulary))
    rows, terms, weights = [], [], []
    for row, (_, text) in enumerate(docs):
        known = Counter(vocabulary[t.encode()] for t in plain_terms(text) if t.encode() in vocabulary)
        for term, times in sorted(known.items()):
            rows.append(row)
            terms.append(term)
            weights.append(min(1_000 * times, 990_000) + 7 * term % 900)
    rows, terms, weights = (np.array(x, np.int64) for x in (rows, terms, weights))
    table = np.zeros((len(docs), len(vocabulary)), np.int64)
    table[rows, terms] = weights
    ids = list(range(len(docs)))
    for limit in (5, 4_096):
        best = [ranked.Best(10) for _ in queries]
        met = skipped = 0
        for group in ranked.grouped(queries, limit):
            shard = ranked.Shard(len(docs), rows, terms, weights, group, value)
            for query, own in zip(group.queries, group.own):
                counts = shard.search(own, best[query], ids)
                met, skipped = met + counts[0], skipped + counts[1]
        for query, own in zip(queries, best):
            scores = table[:, query.terms] @ value[query.terms]
            plain = sorted((-int(s), False, i) for i, s in enumerate(scores) if s > 0)[:10]
            assert own.rows == plain
        assert 0 < skipped < met


def test_long_texts_are_cut_between_terms(monkeypatch):
    draw = random.Random(6)
    raw = "".join(draw.choice("abZé .9-\n") for _ in range(5_000)).encode()
    whole = [t for part in ranked.terms_of(raw) for t in part]
    for chunk in (1, 2, 7, 64):
        monkeypatch.setattr(ranked, "_CHUNK", chunk)
        assert [t for part in ranked.terms_of(raw) for t in part] == whole
    assert whole == [t.encode() for t in plain_terms(raw.decode())]
