"""Coordinate matrices: canonical form, mirroring, restriction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    """A square matrix: ``entries`` holds unique (r LONG, c LONG, v DOUBLE), 0-based."""

    entries: DataFrame
    n: int


def canonical(entries: DataFrame) -> DataFrame:
    """Sum duplicates and drop exact zeros (either sign); NaN stays."""
    return (
        entries.groupBy("r", "c")
        .agg(F.sum(F.col("v").cast("double")).alias("v"))
        .filter(F.col("v") != 0)
    )


def mirrored(entries: DataFrame, sign: int = 1) -> DataFrame:
    """Add the transposed off-diagonal entries, negated for ``sign=-1``."""
    copies = F.array(
        F.struct("r", "c", "v"),
        F.struct(F.col("c").alias("r"), F.col("r").alias("c"), (F.col("v") * sign).alias("v")),
    )
    kept = F.when(F.col("r") == F.col("c"), F.slice(copies, 1, 1)).otherwise(copies)
    return entries.select(F.inline(kept))


def between(column: str, begin: int | None, end: int | None) -> Column:
    """Half-open range predicate on ``column``; pushed into the scan by Spark."""
    test = F.lit(True)
    if begin is not None:
        test = test & (F.col(column) >= begin)
    if end is not None:
        test = test & (F.col(column) < end)
    return test


def shifted(entries: DataFrame, rows: int, columns: int) -> DataFrame:
    return entries.select(
        (F.col("r") + rows).alias("r"), (F.col("c") + columns).alias("c"), "v"
    )


def scaled(entries: DataFrame, factor: float) -> DataFrame:
    return entries.withColumn("v", F.col("v") * F.lit(float(factor)))


def all_rows(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("r"))
