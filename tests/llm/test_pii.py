"""Personal data: base spans against the plain patterns, planted disguises, offsets."""

import hashlib
import random
import re

import pytest

from statepath.llm import pii
from statepath.llm.queries import QUERIES

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = (
                True,
                kind == 1 and all(int(p) <= 255 for p in m[0].split(".")),
                16 <= len(digits) <= 19 and plain_luhn(digits),
                8 <= len(digits) <= 15,
            )[kind]
            if ok:
                found.append((kind, *m.span()))
    return found


def test_base_spans_equal_the_plain_patterns():
    draw = random.Random(8)
    parts = ["a", "B.", "@", "@@", "x.y", "-", "+", "+4", "1", "23.", "255.", "256.", "0.0.0.1", " ", "4111 1111 1111 1111", "(", ")", ".", "é", "\n", "%", "_", "7-", "12345678"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(1, 14)))
        assert pii.detect(text) == plain_base(text), text
        assert {s[:3] for s in pii.find(text) if s[3]} == set(plain_base(text))


CASES = [
    # text, kind, what of it is personal
    ("ask jane.doe [at] example [dot] org now", "email", "jane.doe [at] example [dot] org"),
    ("ask jane.doe(at)example.org now", "email", "jane.doe(at)example.org"),
    ("ask jane at example dot org now", "email", "jane at example dot org"),
    ("ask jane @ example.org now", "email", "jane @ example.org"),
    ("ask jаne@exаmple.org now", "email", "jаne@exаmple.org"),
    ("ask ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ now", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｏｒｇ"),
    ("ask ja​ne@exam­ple.org now", "email", "ja​ne@exam­ple.org"),
    ("é host one nine two dot one six eight dot zero dot one", "ip", None),
    ("from 10 dot 0 dot zero dot seven on", "ip", "10 dot 0 dot zero dot seven"),
    ("from 10[.]0[.]0[.]7 on", "ip", "10[.]0[.]0[.]7"),
    ("pay ４１１１ １１１１ １１１１ １１１１ now", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("pay four one one one 1111 1111 one one one one now", "card", "four one one one 1111 1111 one one one one"),
    ("pay 4111 1111‑1111 1111 now", "card", "4111 1111‑1111 1111"),
    ("call plus four nine three zero one two three four five six seven today", "phone", "plus four nine three zero one two three four five six seven"),
    ("ruf +49 drei null eins zwei drei vier fünf an", "phone", "+49 drei null eins zwei drei vier fünf"),
    ("call +١ (٢٠٢) ٥٥٥-٠١٤٣ today", "phone", "+١ (٢٠٢) ٥٥٥-٠١٤٣"),
]


@pytest.mark.parametrize(("text", "kind", "expected"), CASES)
def test_disguises_are_found_at_their_source_characters(text, kind, expected):
    added = [(pii.KINDS[k], text[s:e]) for k, s, e, base in pii.find(text) if not base]
    # spelled figures with gaps between the digits of a part are no address
    assert (added == []) if expected is None else ((kind, expected) in added)
    assert all(text[s:e] in text for _, s, e, _ in pii.find(text))


def test_prose_gets_no_spans():
    for text in (
        "Look at the dot on the i at example.com, one of two or three.", "He met me at noon. Dot com was a word.",
        "un deux trois, six et sept", "eins zwei drei vier fünf", "Вася пошёл домой в 12.30", "a (at) b", "x [dot] y", "",
        "@ @ . at dot", "one", "version 1.2.3", "point of order at point two",
    ):
        assert pii.find(text) == [], text


def test_spans_map_back_through_every_step():
    draw = random.Random(2)
    for _ in range(2_000):
        text = "".join(draw.choice("abcdef") for _ in range(30))
        cuts = sorted(draw.sample(range(31), 6))
        edits = [(a, b, draw.choice(["", "Z", "YY"])) for a, b in zip(cuts[::2], cuts[1::2])]
        step = pii.Rewritten(text, edits)
        plain, origin, place = "", [], 0
        for a, b, out in [*edits, (30, 30, "")]:
            plain += text[place:a] + out
            origin += [(i, i + 1) for i in range(place, a)] + [(a, b)] * len(out)
            place = b
        assert step.text == plain
        for i in range(len(plain)):
            for j in range(i + 1, len(plain) + 1):
                assert step.source(i, j) == (origin[i][0], origin[j - 1][1])


def test_long_texts_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 300_000, "1." * 300_000, "@" * 300_000, "a@" * 200_000, "+1" + "(" * 500_000, "one " * 100_000, "one two ab " * 50_000, "+1 " * 100_000, " at a" * 100_000, "( at " * 50_000, "1 " * 200_000):
        pii.find(text)


def test_query_equals_brute_force_with_awkward_rows(spark, tmp_path):
    rows = [(i, text) for i, (text, _, _) in enumerate(CASES)]
    rows += [(100, None), (101, ""), (None, "no id a@b.c"), (7, "again 1.2.3.4"), (7, "again 1.2.3.4"), (102, "x " * 200_000 + "é a.b@c.de")]
    rows += [(103, "+1 (499) 555-6503 4111-1111-1111-1111 ü 8.196.197.208 re.46@mail8.example.com")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, found string")
    frame.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, text in rows:
        base = plain_base(text or "")
        listed = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)
        counts = [sum(k == kind for k, *_ in base) for kind in range(4)]
        digest = hashlib.sha256(listed(base).encode()).hexdigest()
        expected.append((doc_id, *counts, digest, listed(pii.find(text or ""))))
    result = QUERIES["op13_pii"](spark, str(tmp_path))
    assert sorted(map(tuple, result.collect()), key=str) == sorted(expected, key=str)
    kept = pii.scan(frame)
    assert kept.columns == ["doc_id", "text", "found"] and pii.scan(frame.where("false")).count() == 0
