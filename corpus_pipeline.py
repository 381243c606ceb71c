"""From documents to token ids: the stages of a training corpus, one operator each.

Each stage works on all rows that its predecessor kept; ``run`` writes what a stage
returns and the next one reads it. Columns of the documents may have any names besides
doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statepath.llm import decontamination, exact_dedup, sentencepiece_bpe, similar, toxicity
from statepath.llm.common import set_aside, table
from statepath.llm.queries import toxicity_model
from statepath.storage import materialize, new_path, release

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not predict to be toxic.

    Null and empty texts are scored as texts without words; rows that repeat are decided
    alike; no documents give none. So it is in every stage.
    """
    hidden, back = set_aside(docs, "doc_id", "text")
    model = toxicity_model(hidden, table(spark, sf_dir, "labels"))
    scored = toxicity.score(hidden, model, with_spans=False)
    return back(scored.where("predicted = 0"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id; null and empty texts are equal.

    Of rows that share this id as well, one stays.
    """
    return exact_dedup.remove_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates the one with the least doc_id.

    SimHash finds them, an exact check of 4/5 of the shingles of five words decides, and
    pairs whose fingerprints differ too much are found by their rare shingles.

    Rows that share this id stay together; texts without words are one group.
    """
    return similar.remove_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty is in a window of a benchmark item.

    Null and empty texts have no words and stay.
    """
    hidden, back = set_aside(docs, "doc_id", "text")
    scanned = decontamination.scan(hidden, table(spark, sf_dir, "benchmark"))
    return back(decontamination.remove_documents(scanned))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids of the text with an end id, and a digest of what they decode to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sentencepiece_bpe.round_trip(docs.select("doc_id", "text"), path, keep_text=False)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]

# The model, the fingerprints and the vocabulary are beyond SQL; tests/llm compares the
# stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = new_path(spark)
        docs = materialize(stage(spark, docs, sf_dir), path)
        if before is not None:
            release(spark, before)
        before = path
    return docs
