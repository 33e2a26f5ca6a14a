"""The corpus pipeline: stages over the documents table, each written as Parquet and read again.

A stage takes the documents its predecessor kept. Quality rules drop rejected documents and
take out boilerplate lines, line dedup takes out repeated lines, near-dedup keeps one document
of each group, the secret scan redacts, and packing returns the pieces and their places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrel.llm import line_dedup, near_dedup, packing, quality, secrets
from matrel.llm.common import read_table
from matrel.session import new_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean(docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs, copy_share=None)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", repeated_lines),
    ("near_dedup", near_duplicates),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL expresses neither the edit join nor the forest nor the packing; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the rows of the last one."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
