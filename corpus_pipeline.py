"""From raw documents to training windows: five stages, each over all that the one before it kept."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import ngram_join, packing, pii, suffix_dedup, toxicity
from tesserae.llm.shared import new_path, ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on sf_dir's labelled documents, doesn't reject."""
    ship(spark)
    read = lambda name: spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return toxicity.reject(docs, toxicity.fit_tables(read("documents"), read("labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates, and all others."""
    ship(spark)
    return ngram_join.keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they come first."""
    ship(spark)
    return suffix_dedup.remove(docs)


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced by the names of their types."""
    ship(spark)
    return pii.redact(docs)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training windows of the documents that are left."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_join", without_near_duplicates),
    ("suffix_dedup", without_repeats),
    ("pii", without_private_data),
    ("packing", windows),
]

#: Trained and sequential stages have no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on sf_dir's documents, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
