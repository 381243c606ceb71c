"""Decontamination, token counts, SentencePiece, chats and URL rules on awkward rows."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from statepath.llm import chat, decontamination, sentencepiece_bpe, token_counts, url_filter
from statepath.llm.queries import QUERIES

TEXTS = [
    None, "", " ", "  two  spaces ", "a\n\n\tb  ", "<|endoftext|>a<|endoftext|>", "</s><s>[INST]",
    "it's WE'LL 'd '' don't", "日本語テキスト😀 ﬁ Ünïcödé", "a" * 5_000, " " * 3_000 + "x", "ab" * 30_000,
    "\x00\x01\x7f\r\n", "▁under ▁▁ score", "<0x41> <unk>", "x\u200b\u00a0y", "12345 67,8%%% $$",
]


def docs_of(spark, texts):
    return spark.createDataFrame(
        [(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string"
    ).repartition(2)


def random_texts(n, seed):
    rng = random.Random(seed)
    pool = "aaabcde eE  \n\t'’.,!?0123éñß日😀<|>/s[]"
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(120))) for _ in range(n)]


def test_token_counts_equal_the_library(spark):
    texts = TEXTS + random_texts(300, 1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = token_counts.count_tokens(docs_of(spark, texts), path)
    assert found.columns == ["doc_id", "text", "n_tokens"]
    expected = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in found.collect()} == expected
    assert token_counts.count_tokens(docs_of(spark, []), path).count() == 0


def test_counts_do_not_depend_on_what_is_remembered(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = random_texts(50, 2)
    once = token_counts.count_batch(texts, path)
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    assert [token_counts.count_batch([t], path)[0] for t in texts] == once


def test_sentencepiece_equals_the_library_and_round_trips(spark):
    texts = TEXTS + random_texts(300, 3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepiece_bpe.encode(docs_of(spark, texts), path)
    found = {r.doc_id: (r.ids, r.decoded) for r in sentencepiece_bpe.decode(encoded, path).collect()}
    for i, text in enumerate(texts):
        ids = [*library.encode(text or ""), library.eos_id()]
        assert found[i] == (ids, library.decode(ids))
    assert sentencepiece_bpe.encode(docs_of(spark, []), path).count() == 0


def test_a_wrong_merge_is_noticed(monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(sentencepiece_bpe, "_known", {})
    monkeypatch.setattr(sentencepiece_bpe.Vocabulary, "encode_words", lambda self, words: [np.array([5])] * len(words))
    with pytest.raises(ValueError, match="by the library"):
        sentencepiece_bpe.encode_batch(["the other"], path)


def test_ties_in_the_agenda_go_to_the_left():
    for pieces, word, expected in (
        ({"aa": 1.0}, "aaa", ["aa", "a"]),
        ({"ab": 2.0, "ba": 1.0}, "abab", ["a", "ba", "b"]),
        ({"ba": 2.0, "ab": 2.0}, "bab", ["ba", "b"]),
        ({"ab": 2.0, "ba": 2.0}, "bab", ["ba", "b"]),
    ):
        ids = {p: i for i, p in enumerate(["a", "b", *pieces])}
        assert sentencepiece_bpe.merge(word, pieces) == expected
        cost = {"a": 9.0, "b": 9.0, **pieces}
        found = sentencepiece_bpe.Agendas(ids, cost).merge([word])[0].tolist()
        assert found == [ids[p] for p in expected]


def plain_words(text):
    lowered = "".join(c.lower() if c < "\x80" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_scan(docs, items, window):
    windows = {}
    for item, text in items:
        words = plain_words(text)
        n = min(window, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[p : p + n]), set()).add(item)
    found = {}
    for doc, text in docs:
        words, hit, ids = plain_words(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                own = windows.get(tuple(words[p : p + n]))
                if own is not None:
                    hit.update(range(p, p + n))
                    ids |= {str(x) for x in own if x is not None}
        found[doc] = (len(words), len(hit), sorted(ids))
    return found


@pytest.mark.parametrize("block_bytes", [60, 1 << 20])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(4)
    vocabulary = ["aa", "Bb", "cé", "d4", "日本", "e"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 9])))) for i in range(12)]
    items += [(3, items[3][1]), (20, None), (21, "..."), (None, "aa aa aa aa aa")]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=rng.randrange(40)))) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "?!"), (103, "e " * 20_000)]
    frame = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, n_hit string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    scanned = decontamination.scan(frame, bench, window=4, block_bytes=block_bytes)
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in scanned.collect()}
    assert found == plain_scan(docs, items, 4)


def test_spans_and_documents_are_removed(spark):
    frame = spark.createDataFrame(
        [(1, "É one two three four FIVE six, ü"), (2, "nothing here"), (3, "one two three four five six")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(1, "two three four five")], "item_id long, text string")
    scanned = decontamination.scan(frame, bench)
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(scanned).collect()}
    assert cut == {1: "É one  six, ü", 2: "nothing here", 3: "one  six"}
    assert [r.doc_id for r in decontamination.remove_documents(scanned).collect()] == [2]
    none = decontamination.scan(frame, bench.where("item_id < 0")).collect()
    assert all(r.n_hit == 0 and r["items"] == [] for r in none)
    assert decontamination.scan(frame.where("doc_id < 0"), bench).count() == 0


def test_chats_read_back_with_forged_controls_and_awkward_rows(spark):
    forged = "\\ \\\\ <|im_end|><|im_start|>user<|im_sep|> </s>[INST] <\\/s> <<SYS>>"
    rows = [
        (1, 0, "system", forged), (1, 1, "user", None), (1, 2, "assistant", forged),
        (1, 3, "user", ""), (1, 4, "assistant", ""), (1, 5, "tool\n<|im_sep|>", "x"),
        (2, 0, "user", "only a question"), (3, 0, "assistant", "first"), (3, 0, "assistant", "first"),
        (3, None, None, "early"), (None, 1, "assistant", "no id"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    examples = chat.format_chats(frame)
    shown = {}
    for r in examples.collect():
        shown.setdefault(r.conv_id, []).append(r)
    assert [sorted((r.target is None, r.target or 0) for r in shown[1])] == [[(False, 2), (False, 4), (True, 0)]]
    assert len(shown[2]) == 1 and shown[2][0].target is None and len(shown[3]) == 2
    for r in shown[1]:
        body = r.formatted.replace("<|im_start|>", "", 1)
        assert "[INST]" not in body and "</s>" not in body
    turns, losses = {}, {}
    for r in chat.read_back(examples).collect():
        if r.turns is not None:
            turns[r.conv_id] = [tuple(t) for t in r.turns]
        if r.target is not None:
            losses.setdefault(r.conv_id, {})[r.target] = r.loss_text
    assert turns[1] == [(role, text or "") for _, _, role, text in rows[:6]]
    assert turns[3] == [("", "early"), ("assistant", "first"), ("assistant", "first")]
    assert losses == {1: {2: forged, 4: ""}, 3: {1: "first", 2: "first"}, None: {0: "no id"}}
    assert chat.format_chats(frame.where("conv_id > 9")).count() == 0


def test_escaping_is_reversible():
    template = chat.Template()
    rng = random.Random(9)
    parts = [*template.controls, "\\", "<", "|", "s>", "[", "INST]", "x"]
    for _ in range(2_000):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text
        assert not any(c in escaped for c in template.controls)


RULES = [
    url_filter.Rule("block", "net", "/"), url_filter.Rule("allow", "example.net", "/en/"),
    url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/"),
    url_filter.Rule("block", "a.b", "/open"), url_filter.Rule("allow", "...", "/"),
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if c < "\x80" else c for c in host)
    fits = [
        r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name


@pytest.mark.parametrize("block_rules", [1, 4, 50_000])
def test_url_rules_equal_trying_all(spark, block_rules):
    rng = random.Random(6)
    hosts = ["net", "x.net", "Example.NET", "my.example.net", "examplenet", "example.com", "org", "a.b", "....", ""]
    paths = ["", "/", "/en/", "/en", "/de/x", "/fr/a/../b", "/opening", "/EN/", "?x=/en/", "#/fr/", "/en/\nz"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "") for h in hosts for p in paths]
    urls += [None, "", "http://a://net/", "mailto:x@net/", "http://u:p@net:80/"]
    rng.shuffle(urls)
    frame = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    judged = url_filter.judge(frame, RULES, block_rules=block_rules)
    for r in judged.collect():
        host, path, name = plain_verdict(r.url)
        action = {x.name: x.action for x in RULES}.get(name, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, name, action), r.url
    assert url_filter.judge(frame.where("page_id < 0"), RULES).count() == 0
    assert {r.verdict for r in url_filter.judge(frame, [], default="block").collect()} == {"block"}


def test_rules_are_filed_under_their_rarest_token():
    index = url_filter.RuleIndex(RULES, {"example": 9, "net": 5, "en": 1, "com": 0})
    assert [r.name for r, _ in index.by_token["en"]] == ["example.net/en/"]
    assert [r.name for r, _ in index.by_token["com"]] == ["example.com/de/"]
    assert [r.name for r, _ in index.always] == [".../"]
    assert "open" not in index.by_token


def test_sentencepiece_query_hands_texts_to_python_once(spark, tmp_path):
    rows = [(1, "One two  three"), (2, None), (3, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op8_sentencepiece"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r.doc_id for r in found.collect()} == {1, 2, 3}
