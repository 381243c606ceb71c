"""The Merkle manifest against a tree built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from statepath.llm import merkle
from statepath.llm.queries import LEAF_COLUMNS, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def siblings(levels, at):
    for level in levels[:-1]:
        first = at // 8 * 8
        yield level[first:at], level[at + 1 : first + 8]
        at //= 8


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
        groups[name].sort(key=key)
        trees[name] = levels_of([leaf(r) for r in groups[name]])
    top = levels_of([trees[n][-1][0] for n in names])
    found = []
    for place, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            shown = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                shown = (row[0], lowered(row[1]), *row[2:])
            proof = [*siblings(trees[name], at), *siblings(top, place)]
            folded = leaf(shown)
            for before, after in proof:
                folded = sha(*before, folded, *after)
            listed = [s for before, after in proof for s in (*before, *after)]
            found.append(
                (row[0], leaf(row), trees[name][-1][0], top[-1][0], sha(*listed), folded, folded == top[-1][0])
            )
    return sorted(found, key=str)


def manifest(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{path}/documents.parquet")
    return sorted(map(tuple, QUERIES["op12_merkle_manifest"](spark, str(path)).collect()), key=str)


def test_query_equals_plain_trees_with_awkward_rows(spark, tmp_path):
    draw = random.Random(4)
    rows = [(i, f"Text {i} Ünï", draw.choice(["en", "en", "en", "de"]), "web", 5) for i in range(700)]
    rows += [(1_000, None, None, None, None), (None, "no id", "en", "s", 1), (None, "NO id", "en", "s", 1)]
    rows += [(7, "again", "en", "s", 2)] + [(8, "Same", "fr", "s", 2)] * 9 + [(9, "", "", "", 0), (10, "Long " * 50_000, "es", "x", 3)]
    assert manifest(spark, tmp_path, rows) == plain_manifest(rows)


@pytest.mark.parametrize(("levels", "n"), [(1, 1), (1, 64), (1, 65), (2, 513)])
def test_blocks_of_any_size_give_the_same_trees(spark, levels, n):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(n)]
    rows += [(i, f"T{i}", f"l{i:03}", "s", 1) for i in range(n, n + 10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    columns = [F.col(c) for c in LEAF_COLUMNS]
    found = merkle.witness_rows(docs, merkle.leaf_digest(columns), "lang", levels=levels)
    plain = {r[0]: r[1:5] for r in plain_manifest(rows)}
    assert {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256) for r in found.collect()} == plain
    assert found.where("not verified or folded_root <> root").count() == 0


def test_witnesses_grow_while_items_are_appended():
    tree = merkle.Appender()
    for i in range(7):
        tree.append(f"{i}")
    assert tree.witnesses[0] == []
    tree.append("7")
    assert tree.witnesses[3] == [("012", "4567")]
    for i in range(8, 64):
        tree.append(f"{i}")
    assert [len(w) for w in tree.witnesses] == [2] * 64
    root = tree.finish(2)
    assert all(merkle.fold(f"{i}", w) == root for i, w in enumerate(tree.witnesses))
    assert merkle.fold("x", tree.witnesses[5]) != root


def test_no_rows_and_clashing_columns(spark):
    rows = [(1, "a", "x", "y", 3), (2, None, "x", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, digest string, tree string, pos string, n long")
    leaf = merkle.leaf_digest([F.col("doc_id"), F.col("digest")])
    found = merkle.witness_rows(docs, leaf, "tree").collect()
    assert len(found) == 2 and all(r.verified for r in found)
    assert merkle.witness_rows(docs.where("n > 9"), leaf, "tree").count() == 0
    with pytest.raises(ValueError):
        merkle.witness_rows(docs.withColumnRenamed("doc_id", "root"), leaf, "tree", "root")
