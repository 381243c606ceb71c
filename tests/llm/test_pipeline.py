"""The corpus pipeline against brute force, on rows with planted cases."""

import public_tokenizers
import sentencepiece
from test_models import toxic_corpus
from test_similar import plain_groups
from test_texts import plain_scan

import corpus_pipeline

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [(i, t, y) for i, t, y in toxic_corpus(300)]
    clean = [(i, t) for i, t, y in rows if not y and len(t.split()) > 40]
    docs = [(i, t) for i, t, _ in rows]
    docs += [(1_000 + i, t) for i, t in clean[:10]]  # copies
    docs += [(2_000, BENCH), (2_001, f"{BENCH} " + "other " * 40), (2_002, f"{BENCH} " + "q w e r t " * 70)]
    docs += [(3_000, None), (3_001, ""), (3_002, "long " * 30_000), (3_003, clean[11][1] + " zz")]
    frame = spark.createDataFrame([(*d, "l", "s", 5, "clash") for d in docs], "doc_id long, text string, lang string, source string, n_chars long, n_hit string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, y) for i, _, y in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(5, BENCH)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    found, sizes = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, found, str(tmp_path))
        assert found.columns == frame.columns
        sizes.append({r.doc_id for r in found.select("doc_id").collect()})

    toxic = {i for i, _, y in rows if y}
    left = {i: t for i, t in docs if i not in toxic}
    assert sizes[0] == set(left)
    best = {}
    for i, t in left.items():
        best[t or ""] = max(i, best.get(t or "", i))
    left = {i: t for i, t in left.items() if best[t or ""] == i}
    assert sizes[1] == set(left)
    roots = plain_groups(list(left.items()))
    left = {i: t for i, t in left.items() if roots[i] == i}
    assert sizes[2] == set(left)
    assert 3_003 not in left or clean[11][0] not in left
    scan = plain_scan(list(left.items()), [(5, BENCH)], 13)
    left = {i: t for i, t in left.items() if not (scan[i][1] and 20 * scan[i][1] >= scan[i][0])}
    assert sizes[3] == set(left) and 2_002 in left and not {2_000, 2_001} & set(left)

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    result = {r.doc_id: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert result == {i: [*library.encode(t or ""), library.eos_id()] for i, t in left.items()}


def test_empty_documents(spark, tmp_path):
    for name, schema in (
        ("documents", "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
