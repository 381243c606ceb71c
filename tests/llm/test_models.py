"""Language and toxicity models: held-out accuracy, awkward rows, exact probabilities."""

import functools
import itertools

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from statepath.llm import language, toxicity
from statepath.llm.common import bounded_sample
from statepath.llm.queries import QUERIES


def test_language_accuracy_on_held_out_rows(spark):
    found = QUERIES["op6_language_id"](spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang")
    right = found.where("held_out").join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")))
    assert right.first()[0] >= 0.98
    assert found.count() == truth.count()
    assert found.where("score < 0 or score > 1 or score is null").isEmpty()


def plain_code_length(counts, text, known):
    """Bits of a text by the definition of the tree, one byte at a time."""
    data = b"\n" * language.ORDER + text
    total = 0.0
    for i in range(language.ORDER, len(data)):

        @functools.cache
        def probability(byte, length, i=i):
            if length < 0:
                return 1 / 256
            context = data[i - length : i]
            own = counts.get(context, {}) if length < language.ORDER or context in known else {}
            if not own:
                return probability(byte, length - 1)
            n, d = sum(own.values()), len(own)
            if byte in own:
                return own[byte] / (n + d)
            left = sum(probability(b, length - 1) for b in range(256) if b not in own)
            return d / (n + d) / left * probability(byte, length - 1)

        total -= np.log2(probability(data[i], language.ORDER))
    return total


def test_code_lengths_equal_the_definition():
    samples = {"x": [b"abracadabra abra", b"cab"], "y": [b"banana band", b"\xc3\xa9\xc3\xa9"]}
    trees, grams, everywhere = {}, {}, {}
    for name, texts in samples.items():
        tree, numbers = {}, {}
        for text in texts:
            data = b"\n" * language.ORDER + text
            for i in range(language.ORDER, len(data)):
                for length in range(language.ORDER + 1):
                    own = tree.setdefault(data[i - length : i], {})
                    own[data[i]] = own.get(data[i], 0) + 1
                context = data[i - language.ORDER : i]
                everywhere[context] = everywhere.get(context, 0) + 1
                number = int.from_bytes(data[i - language.ORDER : i + 1], "big")
                numbers[number] = numbers.get(number, 0) + 1
        trees[name] = tree
        grams[name] = (np.array(list(numbers)), np.array(list(numbers.values())))
    known = {c for c, n in everywhere.items() if n >= language.LEAST_CONTEXT}
    model = language.Model.build(["x", "y"], [grams["x"], grams["y"]])
    texts = [b"abra", b"banana", b"zzz\x00", b"\xc3\xa9a", b"", b"abrabra"]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    bits = model.code_lengths(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for i, text in enumerate(texts):
        for j, name in enumerate(("x", "y")):
            assert bits[i, j] == pytest.approx(plain_code_length(trees[name], text, known), rel=1e-4, abs=1e-6)


def test_language_of_awkward_rows(spark):
    rows = [
        (1, "the cat and the dog " * 20, "en"), (2, "der Hund und die Katze " * 20, "de"),
        (3, None, "en"), (4, "", None), (5, "12 %% !", "de"), (6, "die Katze", None),
        (7, "日本", None), (None, "the dog", "en"), (8, "the " * 40_000, "en"), (8, "the dog", "en"),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, score int")
    model = language.learn(docs)
    assert model.languages == ["de", "en"]
    found = [(r.doc_id, r.lang_pred, r.score) for r in language.predict(docs, model).collect()]
    names = {(i, name) for i, name, _ in found}
    assert {(3, "und"), (4, "und"), (5, "und"), (6, "de"), (None, "en"), (8, "en")} <= names
    assert all(0 <= s <= 1 for _, _, s in found) and len(found) == len(rows)
    empty = language.learn(docs.where("doc_id > 99"))
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(docs.where("doc_id > 99"), model).count() == 0


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    rows = [(i, "big" if i % 10 else "small") for i in range(5_000)] + [(7, "big")] * 5
    frame = spark.createDataFrame(rows, "id long, label string")
    first = sorted(map(tuple, bounded_sample(frame, "label", 100, "id").collect()))
    again = sorted(map(tuple, bounded_sample(frame.repartition(7), "label", 100, "id").collect()))
    assert first == again and len(first) == 200


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = toxicity.Field(np.zeros(1, np.float32), 0.0, rng.normal(size=(2, 2)), rng.normal(size=2))
    emission = rng.normal(size=(3, 5))
    filled = np.arange(5) < np.array([5, 3, 1])[:, None]
    found, pairs = field.posteriors(np.where(filled, emission, 0), filled, with_pairs=True)
    expected_pairs = np.zeros((2, 2))
    for row in range(3):
        n = int(filled[row].sum())
        weights = {}
        for labels in itertools.product((0, 1), repeat=n):
            score = field.start[labels[0]] + sum(emission[row, t] for t in range(n) if labels[t])
            score += sum(field.pairs[a, b] for a, b in itertools.pairwise(labels))
            weights[labels] = np.exp(score)
        total = sum(weights.values())
        for t in range(n):
            assert found[row, t] == pytest.approx(sum(w for x, w in weights.items() if x[t]) / total)
        for t in range(n - 1):
            for labels, w in weights.items():
                expected_pairs[labels[t], labels[t + 1]] += w / total
    assert pairs == pytest.approx(expected_pairs)


def toxic_corpus(n=400, seed=1):
    rng = np.random.default_rng(seed)
    common = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        words = list(rng.choice(common, int(rng.integers(5, 80))))
        toxic = int(i % 4 == 0)
        if toxic:
            words.insert(int(rng.integers(len(words))), f"vile{rng.choice(list('abcdefgh'))}x" if i % 8 else "Awful")
        rows.append((i, " ".join(words), toxic))
    return rows


def test_field_marks_toxic_words_in_unseen_documents(spark):
    rows = toxic_corpus()
    model = toxicity.fit([(t, y) for i, t, y in rows if i % 5])
    extra = [(1_000, None), (1_001, ""), (1_002, "?!"), (1_003, "word1 " * 30_000 + "awful"), (None, "é vilecx, ü"), (1_003, "word1")]
    frame = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows] + [(*e, "") for e in extra], "doc_id long, text string, score string")
    found = toxicity.score(frame, model).collect()
    truth = {i: y for i, _, y in rows}
    assert all(r.predicted == truth[r.doc_id] for r in found if r.doc_id in truth)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    by_text = {(r.doc_id, (r.text or "")[:9]): r for r in found}
    assert by_text[1_000, ""].predicted == by_text[1_001, ""].predicted == by_text[1_002, "?!"].predicted == 0
    assert by_text[1_003, "word1 wor"].predicted == 1
    shown = by_text[None, "é vilecx,"]
    assert [(s.start, s.end) for s in shown.toxic_spans] == [(2, 8)]
    assert toxicity.score(frame.where("doc_id < 0"), model).count() == 0


def test_toxicity_without_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    for given in (labels, labels.where("doc_id = 7")):
        model = toxicity.learn(docs, given)
        assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0, 0]


def test_toxicity_on_held_out_rows(spark):
    found = QUERIES["op9_toxicity"](spark, SF_DIR)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").select("doc_id", "toxic")
    known = found.where("held_out").join(labels, "doc_id")
    assert known.where("toxic = 0 and predicted = 1").count() == 0
    assert known.where("toxic = 1 and predicted = 1").count() >= 0.5 * known.where("toxic = 1").count()


def test_copies_neither_empty_nor_flood_the_language_sample(spark):
    copied = [("x", f"copied text {i % 3} of x") for i in range(900)]
    own = [("y", f"own text {i} of y") for i in range(200)] + [("y", "a hot text of y")] * 600
    frame = spark.createDataFrame(copied + own, "lang string, text string").repartition(7)
    for limit in (2, 50):
        found = [tuple(r) for r in language.sample_texts(frame, "text", "lang", limit).collect()]
        assert len(found) == len(set(found))
        assert sum(x == "x" for x, _ in found) == min(limit, 3)
        assert sum(x == "y" for x, _ in found) == limit
    model = language.learn(frame, limit=1)
    assert model.languages == ["x", "y"]
