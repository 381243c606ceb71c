"""Near duplicates by exact shingle similarity against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from statepath.llm import similar, simhash
from statepath.llm.common import attach_few_groups, attach_groups
from statepath.storage import Scratch, materialize


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(docs):
    sets = {i: shingles(t or "") for i, t in docs}
    root = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def edited(draw, words, places):
    """The words with new ones at some places, each of which changes up to five shingles."""
    words = list(words)
    for place in places:
        words[place] = f"new{draw.integers(1 << 40)}"
    return " ".join(words)


def planted():
    """Isolated pairs with spread edits from one to many, around a similarity of 0.8."""
    draw = np.random.default_rng(11)
    docs = []
    for k in range(90):
        words = [f"w{draw.integers(50_000)}" for _ in range(200)]
        places = draw.choice(200, 1 + k % 9, replace=False)
        docs += [(2 * k, " ".join(words)), (2 * k + 1, edited(draw, words, places))]
    return docs


def found_groups(spark, docs, **options):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    return {r.doc_id: r.component_id for r in similar.similar_groups(frame, **options).collect()}


def test_isolated_pairs_are_linked_from_four_fifths_on_and_only_then(spark):
    docs = planted()
    sets = {i: shingles(t) for i, t in docs}
    values = [similarity(sets[i], sets[i + 1]) for i in range(0, len(docs), 2)]
    assert sum(0.8 <= v < 0.9 for v in values) > 15 and sum(0.65 < v < 0.8 for v in values) > 15
    assert found_groups(spark, docs) == plain_groups(docs)


def test_documents_of_one_template_are_kept(spark):
    draw = np.random.default_rng(3)
    template = " ".join(f"t{i}" for i in range(160))
    docs = [(i, f"{template} " + " ".join(f"o{draw.integers(10**9)}" for _ in range(22))) for i in range(12)]
    sets = [shingles(t) for _, t in docs]
    assert 0.75 < similarity(sets[0], sets[1]) < 0.8
    assert found_groups(spark, docs) == {i: i for i, _ in docs}


@pytest.mark.parametrize("cell", [3, 1_024])
def test_large_groups_and_common_passages(spark, cell):
    draw = np.random.default_rng(5)
    base = [f"b{i}" for i in range(120)]
    passage = " ".join(f"p{i}" for i in range(60))
    docs = [(i, edited(draw, base, draw.choice(120, 1 + i % 5, replace=False))) for i in range(60)]
    # a template with own content, below four fifths of each other
    docs += [(100 + i, passage + " " + " ".join(f"o{draw.integers(10**6)}" for _ in range(12))) for i in range(40)]
    # a chain: each is similar to the next only
    docs += [(200 + i, " ".join(f"c{j}" for j in range(10 * i, 10 * i + 104))) for i in range(12)]
    docs += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one  TWO"), (305, "x " * 3_000), (306, "x " * 5)]
    found = found_groups(spark, docs, cell=cell)
    assert found == plain_groups(docs)
    assert len({found[200 + i] for i in range(12)}) == 1 and len({found[100 + i] for i in range(40)}) == 40


def test_simhash_gives_candidates(spark, monkeypatch):
    # one more occurrence of a shingle of many turns few bits
    draw = np.random.default_rng(7)
    words = [[f"s{draw.integers(50_000)}" for _ in range(300)] for _ in range(8)]
    docs = [(2 * k, " ".join(w)) for k, w in enumerate(words)]
    docs += [(2 * k + 1, " ".join([*w, "end"])) for k, w in enumerate(words)]
    docs += [(100, None), (101, ""), (102, " \n")]
    prints = {i: simhash.fingerprints((t or "").encode())[0] for i, t in docs}
    linked = {i: {j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3} for i in prints}
    assert any(len(linked[2 * k]) > 1 for k in range(8))
    assert any(prints[2 * k] != prints[2 * k + 1] for k in range(8))
    frame = spark.createDataFrame(docs, "id long, content string")
    texts = frame.withColumn("digest", F.md5(F.coalesce("content", F.lit(""))))
    with Scratch(spark) as scratch:
        search = similar._Search(texts, 5, 1_024, scratch)
        ids = {r.node: r.least_id for r in search.nodes.collect()}
        pairs = [(ids[p.a], ids[p.b]) for p in search.close_pairs().collect()]
    # here links make no chains; 100 and 101 are one node
    texts = {i: j for i, j in linked.items() if i in ids.values()}
    expected = {i: j & set(ids.values()) for i, j in texts.items() if len(j & set(ids.values())) > 1}
    assert {i for pair in pairs for i in pair} == set(expected)
    assert len(pairs) == len({frozenset(j) for j in expected.values()}) and all(a in linked[b] for a, b in pairs)

    seen, find = [], similar.find_links
    monkeypatch.setattr(similar, "find_links", lambda *a, **k: seen.append(1) or find(*a, **k))
    kept = corpus_pipeline.drop_near_copies(spark, frame.select(F.col("id").alias("doc_id"), F.col("content").alias("text")), "")
    assert seen and {r.doc_id for r in kept.collect()} == {i for i, root in plain_groups(docs).items() if i == root}


def test_rows_without_a_group_pass_by_the_join(spark):
    rows = spark.createDataFrame([(i, None if i == 5 else f"k{i % 40}") for i in range(200)], "id long, key string")
    groups = materialize(
        spark.createDataFrame([("k3", 5, "x"), ("k4", 5, None), ("gone", 2, "y")], "key string, n long, value string")
    )
    for how in ("left", "inner"):
        expected = sorted(map(str, rows.join(groups, "key", how).select("id", "key", "n", "value").collect()))
        for limit in (1, 3):
            found = attach_few_groups(rows, groups, "key", "n", F.col("id"), how, limit)
            assert found.columns == ["id", "key", "n", "value"]
            assert sorted(map(str, found.collect())) == expected


def test_texts_are_read_by_one_python_pass(spark):
    docs = [(0, "a b c d e f"), (1, ""), (2, None), (3, "A b  c")]
    texts = spark.createDataFrame(docs, "id long, content string").withColumn("digest", F.md5(F.coalesce("content", F.lit(""))))
    read = similar.read_texts(texts)
    assert read._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    prints = {r.id: r.print_0 for r in simhash.add_fingerprints(texts, "content").collect()}
    assert {r.id: r.print_0 for r in read.collect()} == prints


def test_hot_groups_start_no_python_workers(spark):
    rows = spark.range(3_000).select("id", F.when(F.col("id") < 2_000, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    groups = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
    joined = attach_groups(rows, groups, "key", "n", F.col("id"))
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistingRDD" not in plan and "LogicalRDD" not in plan
    assert joined.where("key = 'hot' and n = 2000").count() == 2_000 and joined.count() == 3_000
