"""URL filters: pattern rules found by their rarest literal token.

A rule names a host and the start of a path. It fits that host and its subdomains, if
the path of the URL begins so. Each rule is filed under the one of its complete literal
tokens that the URLs at hand contain least often; the tokens of a URL fetch the rules to
try, and only those run their regular expressions. The longest fitting rule decides.

Host: what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or end, A-Z
lower-cased. Path: what follows up to ``?``, ``#`` or end. A URL that is null or without
``://`` has neither, and no rule fits it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statepath.llm.common import add_columns
from statepath.storage import materialize

# Rules that are broadcast at once, about 1 KB each.
BLOCK_RULES = 50_000
TOKEN = re.compile(r"[A-Za-z0-9]+")
_SPLIT = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """Regular expression over host, a NUL, and path."""
        return rf"(?s)(?:.*\.)?{re.escape(self.host)}\x00{re.escape(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every fitting URL has whole: the last one of an open path end may go on."""
        whole = TOKEN.findall(self.host)
        for found in TOKEN.finditer(self.path):
            if found.end() < len(self.path):
                whole.append(found.group())
        return list(dict.fromkeys(whole))


def parse(url: str | None) -> tuple[str, str]:
    found = _SPLIT.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def tokens(host: str, path: str) -> set[str]:
    return {*TOKEN.findall(host), *TOKEN.findall(path)}


class RuleIndex:
    """Compiled rules under their rarest token; rules without one are always tried."""

    def __init__(self, rules: Sequence[Rule], frequency: dict[str, int]):
        self.by_token: dict[str, list] = {}
        self.always: list = []
        for rule in rules:
            entry = (rule, re.compile(rule.pattern))
            whole = rule.tokens
            if whole:
                rarest = min(whole, key=lambda t: (frequency.get(t, 0), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)

    def best(self, host: str, path: str) -> Rule | None:
        """The longest fitting rule; of equally long ones the first by name, block first."""
        tried = list(self.always)
        for token in tokens(host, path):
            tried.extend(self.by_token.get(token, ()))
        subject = f"{host}\x00{path}"
        fits = [rule for rule, regex in tried if regex.match(subject)]
        return min(fits, key=_rank, default=None)


def _rank(rule: Rule) -> tuple:
    return -len(rule.name), rule.name, rule.action != "block"


def token_frequency(urls: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """In how many URLs the literal tokens of the rules occur."""
    wanted = sorted({t for rule in rules for t in rule.tokens})
    found = F.array_intersect(
        F.regexp_extract_all(F.col(url), F.lit(TOKEN.pattern), F.lit(0)),
        F.array(*[F.lit(t) for t in wanted]).cast("array<string>"),
    )
    counted = urls.select(F.explode(found).alias("token")).groupBy("token").count()
    return Counter({row.token: row["count"] for row in counted.collect()})


def judge(
    urls: DataFrame,
    rules: Sequence[Rule],
    default: str = "allow",
    url: str = "url",
    block_rules: int = BLOCK_RULES,
) -> DataFrame:
    """``urls`` with host, path, rule (null if none fits) and verdict.

    Without a fitting rule the verdict is ``default``. Rules beyond one block are tried
    block by block. Columns with a result's name are replaced.
    """
    spark = urls.sparkSession
    judged = urls.withColumn("rule", F.lit(None).cast("string")).withColumn(
        "verdict", F.lit(None).cast("string")
    )
    results = {"host": "string", "path": "string", "rule": "string", "verdict": "string"}
    for start in range(0, max(1, len(rules)), block_rules):
        block = rules[start : start + block_rules]
        if start:
            judged = materialize(judged)
        shared = spark.sparkContext.broadcast(
            RuleIndex(block, token_frequency(urls, block, url))
        )

        def decide(piece: pa.RecordBatch, shared=shared) -> dict:
            index = shared.value
            hosts, paths, names, verdicts = [], [], [], []
            earlier = zip(piece.column("rule").to_pylist(), piece.column("verdict").to_pylist())
            for text, (name, verdict) in zip(piece.column(url).to_pylist(), earlier):
                host, path = parse(text)
                best = index.best(host, path)
                if name is not None:
                    before = Rule(verdict, name, "")
                    if best is None or _rank(before) <= _rank(best):
                        best = before
                hosts.append(host)
                paths.append(path)
                names.append(best.name if best else None)
                verdicts.append(best.action if best else default)
            return {
                "host": pa.array(hosts, pa.string()),
                "path": pa.array(paths, pa.string()),
                "rule": pa.array(names, pa.string()),
                "verdict": pa.array(verdicts, pa.string()),
            }

        judged = add_columns(judged, decide, results, url, without=("rule", "verdict"))
    return judged
