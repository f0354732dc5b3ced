"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; all but the last return the columns of ``documents``, extra ones of any
name included. An empty table gives an empty result at every stage. Each stage
says what it makes of null texts and ids and of repeated rows; texts of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below the limit. Held-out labels are
    never learnt here either. A null text counts as empty and has the prior's
    score; rows with a null id are judged, never learnt from; repeated rows are
    judged alike, and one row an id is learnt from."""
    from siltstone.llm import toxicity
    from siltstone.llm.queries import HELD_OUT

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.accepted(docs, toxicity.fit(docs, labels, usable=~F.expr(HELD_OUT.format("id"))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints: that of the smallest id,
    null last; of texts that share it the one of least digest, once. Rows that
    share an id but are no copies both stay. Null and empty texts, and texts
    without words, have fingerprint zero and are copies of each other."""
    from siltstone.llm import simhash

    return simhash.distinct_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets replaced; every row stays, and a null text stays
    null. A null source or language is one of its own; repeated rows count once
    by owner and repository and are redacted alike."""
    from siltstone.llm import secret_scan

    return secret_scan.redact_live(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample by calibrated probabilities. A null source or language is a
    value of its own, a null text has no tokens, and repeated rows, as all rows
    without an id, are drawn alike."""
    from siltstone.llm import mixing

    return mixing.sampled(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text, with digests of them and of the decoded text. A
    null text counts as empty; repeated rows and null ids have rows of their
    own."""
    from siltstone.llm import sentencepiece_bpe
    from siltstone.llm.queries import MODEL

    return sentencepiece_bpe.encode_documents(docs, MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The model, the fingerprints and the encoder are not expressible in SQL; the
#: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns, stored; what the stages stored on their way
    is removed as soon as the next stage's rows are written."""
    from siltstone.operators.shared import drop_stored, scratch, stored

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", outer=True)
        if before is not None:
            drop_stored(before)
        before = docs
    return docs
