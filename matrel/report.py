"""Timing of the execution modes and the comparison report.

Protocol: one warm-up, then repetitions; the time of a mode is the median.
Planning, loading and checking are not timed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.session import stage

MODE_ORDER = ("row_adaptive", "merge_preferred_capacity_safe", "dense_only")
RESULT_SCHEMA = "matrix string, mode string, batch string, rep int, ms double, output_nnz long"


def time_modes(spark: SparkSession, matrix: str, runs: dict[str, Callable[[], DataFrame]],
               repetitions: int = 3) -> DataFrame:
    """SAMPLE and TOTAL rows of every mode; the action counts the output cells."""
    rows = []
    for mode, build in runs.items():
        build().count()
        for rep in range(repetitions):
            begin = time.perf_counter()
            cells = build().count()
            rows.append((matrix, mode, "SAMPLE", rep, (time.perf_counter() - begin) * 1000.0, cells))
    samples = spark.createDataFrame(rows, RESULT_SCHEMA)
    return samples.unionByName(totals(samples))


def totals(samples: DataFrame) -> DataFrame:
    return samples.groupBy("matrix", "mode").agg(
        F.lit("TOTAL").alias("batch"), F.count(F.lit(1)).cast("int").alias("rep"),
        F.median("ms").alias("ms"), F.max("output_nnz").alias("output_nnz"))


def check_results(results: DataFrame, repetitions: int, modes: Iterable[str] = MODE_ORDER) -> None:
    """Every matrix has all modes, enough samples, and one output size over the modes."""
    modes = list(modes)
    total = (F.col("batch") == "TOTAL") & F.col("mode").isin(modes)
    per_matrix = results.groupBy("matrix").agg(
        F.count_distinct(F.when(total, F.col("mode"))).alias("modes"),
        F.count_distinct(F.when(total, F.col("output_nnz"))).alias("sizes"))
    per_mode = results.filter(F.col("batch") == "SAMPLE").groupBy("matrix", "mode").count()
    if per_matrix.filter((F.col("modes") != len(modes)) | (F.col("sizes") != 1)).limit(1).count():
        raise ValueError("modes are missing or disagree on the output size")
    if per_mode.filter(F.col("count") != repetitions).limit(1).count():
        raise ValueError("a mode has the wrong number of samples")


def compare_modes(results: DataFrame, baselines: DataFrame | None = None,
                  selected: str = "row_adaptive") -> DataFrame:
    """Per matrix: the fastest mode, the regret of the selected one, and speed-ups.

    ``baselines`` is (matrix, baseline_ms); the least of a matrix is its best.
    """
    only = results.filter(F.col("batch") == "TOTAL")
    per_matrix = only.groupBy("matrix").agg(
        F.max(F.when(F.col("mode") == selected, F.col("ms"))).alias("selected_ms"),
        F.min_by("mode", "ms").alias("oracle_mode"), F.min("ms").alias("oracle_ms"),
    ).withColumn("regret_pct", 100.0 * (F.col("selected_ms") - F.col("oracle_ms")) / F.col("oracle_ms"))
    if baselines is None:
        return per_matrix
    best = baselines.groupBy("matrix").agg(F.min("baseline_ms").alias("best_external_ms"))
    return (
        per_matrix.join(best, "matrix", "left")
        .withColumn("selected_speedup", F.col("best_external_ms") / F.col("selected_ms"))
        .withColumn("oracle_speedup", F.col("best_external_ms") / F.col("oracle_ms"))
    )


def means(compared: DataFrame) -> DataFrame:
    """Arithmetic means over the matrices."""
    names = [c for c in compared.columns if c.endswith(("_ms", "_pct"))]
    return compared.agg(*[F.avg(c).alias(f"mean_{c}") for c in names])


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("append").option("header", True).csv(path)


CELLS_PER_FILE = 1 << 23


def write_product(cells: DataFrame, path: str) -> None:
    """Store a product as Parquet, ranged by row so that row filters skip files; the product runs once."""
    cells = stage(cells)
    files = max(1, -(-cells.count() // CELLS_PER_FILE))
    cells.repartitionByRange(files, "r", "c").sortWithinPartitions("r", "c").write.parquet(path)
