"""Queries of the corpus operators over the whole tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import bpe, exact_dedup, hard_negatives, hmm, line_dedup, near_dedup, packing, quality, runs, secrets, sharding, url_filter, warc
from matrel.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: operator(read_table(spark, folder, "documents"))


def _line_dedup(docs: DataFrame) -> DataFrame:
    rows = line_dedup.repeated_lines(docs, copy_share=None).drop("text_key")
    return rows.withColumn("places", F.array_join(F.col("places").cast("array<string>"), ","))


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": _documents(exact_dedup.exact_dedup),
        "op2_bpe": _documents(bpe.round_trip),
        "op3_near_dedup": _documents(near_dedup.near_duplicates),
        "op4_packing": _documents(packing.pack_documents),
        "op5_quality_rules": _documents(quality.judged),
        "op6_hmm_score": _documents(hmm.score_documents),
        "op7_secret_scan": _documents(lambda docs: secrets.scan(docs).drop("text_key")),
        "op8_line_dedup": _documents(_line_dedup),
        "op9_sharding": _documents(sharding.interleave),
        "op10_url_filter": lambda spark, folder: url_filter.judge_urls(read_table(spark, folder, "pages")),
        "op11_hard_negatives": lambda spark, folder: hard_negatives.mine(read_table(spark, folder, "embeddings")),
        "op12_warc": lambda spark, folder: warc.round_trip(read_table(spark, folder, "pages")),
        "op13_periodic_runs": _documents(runs.digests),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.SQL, "op3_near_dedup": near_dedup.SQL, "op10_url_filter": url_filter.SQL,
            "op11_hard_negatives": hard_negatives.SQL, "op12_warc": warc.SQL}
