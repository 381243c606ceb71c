"""Exact and near duplicates against brute force, with hot groups and awkward rows."""

import random
import re

import numpy as np
import pytest
import xxhash

from statepath.llm import exact_dedup, similar, simhash
from statepath.llm.components import components

AWKWARD = [
    (1, "same", "x"), (2, "same", "y"), (2, "same", "z"), (3, None, "n"), (4, "", "e"),
    (None, "same", "q"), (None, "alone", "r"), (7, "alone", "s"), (8, "Ünï\ncode", "t"),
    (9, "long " * 50_000, "u"),
]


def frame(spark, rows, schema="doc_id long, text string, kept string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def test_copies_with_nulls_ties_and_clashing_columns(spark):
    found = exact_dedup.mark_copies(frame(spark, AWKWARD))
    by_text = {}
    for row in found.collect():
        by_text.setdefault(row.text or "", []).append((row.doc_id, row.keep_id, row.group_size, row.kept))
    assert sorted(by_text["same"], key=str) == [
        (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False),
    ]
    assert sorted(by_text[""]) == [(3, 4, 2, False), (4, 4, 2, True)]
    assert sorted(by_text["alone"], key=str) == [(7, 7, 2, True), (None, 7, 2, False)]
    assert by_text["long " * 50_000] == [(9, 9, 1, True)]


def test_removing_copies_keeps_one_row_and_all_columns(spark):
    docs = frame(spark, AWKWARD)
    kept = exact_dedup.remove_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 4, 7, 8, 9]


def test_no_documents(spark):
    docs = frame(spark, [])
    assert exact_dedup.mark_copies(docs).count() == 0
    assert simhash.near_groups(docs).count() == 0


def test_directory_splits_until_buckets_fit_and_covers_every_hash(spark):
    rng = random.Random(3)
    # crowded: hashes that share their first 9 bits, beyond what is measured first
    crowded = [(rng.getrandbits(55) | 5 << 55) for _ in range(60)]
    spread = [rng.getrandbits(64) for _ in range(300)]
    hashes = np.array(crowded + spread, np.uint64)
    sizes = spark.createDataFrame([(int(h), 10) for h in hashes.view(np.int64)], "hash long, n_bytes long")
    directory = exact_dedup.build_directory(sizes, bucket_bytes=100)
    bucket = directory.bucket(hashes.view(np.int64))
    assert np.bincount(bucket).max() <= 10
    assert len(directory.entries) == 1 << directory.depth
    assert max(directory.local_depth.values()) == directory.depth > 9
    order = np.argsort(hashes)
    assert (np.diff(bucket[order]) >= 0).all()  # numbered along the key


def test_small_buckets_and_colliding_hashes_give_the_same_copies(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"text {rng.randrange(80)}", "") for i in range(600)]
    rows += [(i, "hot", "") for i in range(600, 900)]
    found = exact_dedup.mark_copies(frame(spark, rows), bucket_bytes=64).collect()
    best = {}
    for i, text, _ in rows:
        best[text] = max(i, best.get(text, i))
    assert all(r.keep_id == best[r.text] and r.kept == (r.doc_id == r.keep_id) for r in found)
    # one chain, three texts: bytes decide
    folder = str(tmp_path / "index")
    spark.createDataFrame(
        [(0, 5, "a", 1, 1), (0, 5, "b", 2, 9), (0, 5, "a", 3, 4), (0, 5, "c", 1, None)],
        "bucket long, hash long, text string, n long, last_id long",
    ).write.partitionBy("bucket").parquet(folder)
    chains = sorted((n, last) for _, n, last, _ in exact_dedup.own_buckets(f"file://{folder}", iter([0, 1])))
    assert chains == [(1, None), (2, 9), (4, 4)]


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("group_limit", [7, 2_048])
def test_near_groups_equal_brute_force(spark, group_limit):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(400)) for _ in range(12)]
    texts = []
    for text in base:
        texts.append(text)
        for _ in range(rng.randrange(25)):
            words = text.split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [None, "", " \t", "One", "one two", base[0].upper(), "é É"]
    texts += ["copy of one text"] * 100
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {
        r.doc_id: (r.print_0 % 2**64, r.component_id)
        for r in simhash.near_groups(docs, group_limit=group_limit, keep_text=False).collect()
    }
    prints = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    assert {i: p for i, (p, _) in found.items()} == prints
    assert {i: c for i, (_, c) in found.items()} == plain_components(prints, 3)


def test_groups_of_fingerprints_equal_brute_force_at_every_depth(spark):
    rng = random.Random(11)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    while len(prints) < 500:
        flipped = rng.choice(sorted(prints)[:200])
        for _ in range(rng.randrange(1, 5)):
            flipped ^= 1 << rng.randrange(64)
        prints.add(flipped)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    own = spark.createDataFrame([(p, p) for p in signed], "node long, print_0 long")
    expected = plain_components({p: p % 2**64 for p in signed}, 3)
    for limit in (2, 9, 2_048):
        edges = simhash.find_links(own, group_limit=limit)
        roots = {r.node: r.root for r in components(edges, "a", "b").collect()}
        assert {p: roots.get(p, p) for p in signed} == expected


def test_edited_copies_are_removed_and_others_stay(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(5_000)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(500)]
        rows.append((2 * i, " ".join(words), "a"))
        for _ in range(4):
            words[rng.randrange(500)] = rng.choice(vocabulary)
        rows.append((2 * i + 1, " ".join(words), "b"))
    rows += [(1_000, None, None), (1_001, "", None), (None, "no id here at all", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = similar.remove_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {2 * i for i in range(60)} <= ids
    assert not ids & {2 * i + 1 for i in range(60)}
    assert 1_000 in ids and 1_001 not in ids and None in ids


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(0, 60)]
    hub = [(500, i) for i in range(501, 900)]
    edges = spark.createDataFrame([*path, *hub, (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in components(edges, "a", "b").collect()}
    assert all(roots[i] == 0 for i in range(61)) and all(roots[i] == 500 for i in range(500, 900))
    assert components(edges.where("a < 0"), "a", "b").count() == 0


def test_trees_written_in_parts_connect_the_same(spark):
    prints = [(key, key << 8 | bit, 0) for key in range(12_000) for bit in (1, 2)]
    schema = "key long, print_0 long, rest long"
    keyed = spark.createDataFrame(prints, schema).coalesce(1).sortWithinPartitions("key")
    found = []
    for limit in (1, simhash.TREE_NODES):
        links = simhash._links(keyed, simhash.CLOSE, 2_048, limit).where("not overfull")
        found.append(sorted((r.a, r.b) for r in links.select("a", "b").collect()))
    assert found[0] == found[1] and len(found[0]) == 12_000
    trees = simhash._Trees()
    trees.add(np.array([3]), np.array([1]))
    assert len(trees) == 2


def test_columns_with_working_names_stay(spark):
    names = ["_salt", "_hot", "n_rows", "least_id", "digest", "grouped", "_own_key", "_group_salt", "root"]
    rows = [(i, f"text {i // 2} of some words", *[f"{n}{i}" for n in names]) for i in range(12)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for mark in (exact_dedup.mark_copies, simhash.near_groups, similar.similar_groups):
        found = mark(docs).select("doc_id", "text", *names).collect()
        assert sorted(map(tuple, found)) == rows


def test_rows_without_copies_are_not_shuffled(spark):
    rows = [(i, f"text {i} " + "word " * 50, "k") for i in range(400)]
    rows.append((1_000, rows[7][1], "k"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        kept = exact_dedup.remove_copies(frame(spark, rows))
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert {r.doc_id for r in kept.collect()} == {*range(400), 1_000} - {7}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "LeftSemi" in plan
