"""A training-data pipeline over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's docs.  All stages but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import mixing, near_dup, pieces, quality, secrets
from tallyframe.llm.common import pack, stored, table, unpack


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    scored = quality.score(pack(docs, "text"), quality.train(docs, table(spark, sf_dir, "labels")))
    return unpack(scored.where("predicted = 1"), docs.columns)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dup.deduplicate(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by [SECRET]."""
    found = secrets.scan(pack(docs, "text", "n_chars"), secrets.train(secrets.labelled_samples(docs)))
    return unpack(secrets.redact(found), docs.columns, text=F.col("text"), n_chars=F.col("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their targets."""
    return mixing.mixed_documents(docs)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return pieces.encode(docs).select("doc_id", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dup_stage),
    ("secret_scans", secrets_stage),
    ("source_mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

# the classifier and the shuffled schedule have no SQL equivalent
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
