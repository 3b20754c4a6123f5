"""The corpus pipeline: a mixed, deduplicated, redacted corpus packed into training windows.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from punctua.llm import language, mixing, near_duplicates, packing, secrets
from punctua.llm.common import written


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter or of ambiguous language go."""
    return language.accepted(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group of near copies stays, the one of the smallest id."""
    return near_duplicates.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: each secret becomes the name of its kind in brackets; no document goes."""
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: each document stays as often as its rounded rate says."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of documents in windows of 1024 ids."""
    return packing.pack_documents(docs)


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("secrets", redact), ("mixing", mix), ("packing", pack)]

#: Trained models, hashed indexes and a tokenizer are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
