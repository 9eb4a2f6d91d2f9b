"""A training-data pipeline over ``documents``: quality filter, near-duplicates, benchmark
decontamination, personal data, source mixing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of ``documents``.  The quality stage is a fitted model
and the PII stage rewrites texts, so there is no SQL for the whole.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontamination, mixing, pii, quality, simhash
from quarry.llm.common import held_out, materialize, read_docs
from quarry.llm.toxicity import labelled_sample


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines are mostly bad.  Every row is judged by its own text; null
    and empty texts score 0 and go, repeated rows go or stay together."""
    labels = spark.read.parquet(os.path.join(sf_dir, "labels.parquet"))
    texts, known = labelled_sample(docs, labels, "quality", ~held_out("id", 4, 2), quality.Config().sample)
    return quality.keep_good(docs, quality.fit(texts, known))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of every group of near-duplicates, the one with the smallest id;
    rows that share an id, or have none, go by their own texts."""
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item.  Every row is judged by its own
    text; null and empty texts hold none and stay, repeated rows go or stay together."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(os.path.join(sf_dir, "benchmark.parquet")))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind.  Null texts stay null; repeated rows
    are rewritten alike; no row is dropped."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, row by row; texts without words are not
    taken.  Adds ``copy``."""
    return mixing.take(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", redact_pii),
    ("source mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_docs(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
    return docs
