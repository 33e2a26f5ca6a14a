"""Comparison of a product with its double-precision reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import int_div, lng
from matrel.operators.coo import Matrix
from matrel.operators.joins import Limits, lookup
from matrel.operators.multiply import reference_product

# Tolerance floor and slope, unit roundoff.
ABSOLUTE_TOLERANCE = 1.0e-4
RELATIVE_TOLERANCE = 2.0e-4
UNIT_ROUNDOFF = 2.0**-24


def tolerance(want: Column, abs_sum: Column, terms: Column) -> Column:
    """max(1e-4 + 2e-4 |want|, gamma * abs_sum) with gamma = u / (1 - u), u = (2 terms + 8) 2^-24."""
    u = (F.lit(2.0) * terms + F.lit(8.0)) * F.lit(UNIT_ROUNDOFF)
    gamma = F.when(u < 1.0, u / (F.lit(1.0) - u)).otherwise(F.lit(float("inf")))
    return F.greatest(F.lit(ABSOLUTE_TOLERANCE) + F.lit(RELATIVE_TOLERANCE) * F.abs(want), gamma * abs_sum)


def compare(reference: DataFrame, product: DataFrame) -> DataFrame:
    """(r, c, want, got, allowed, ok) over the union of both structures.

    A missing cell counts as 0. A non-finite result never passes.
    """
    got = product.select("r", "c", F.col("v").alias("got_v"))
    zero = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    joined = reference.join(got, ["r", "c"], "full_outer").select(
        "r", "c", zero("v").alias("want"), zero("got_v").alias("got"),
        tolerance(zero("v"), zero("abs_sum"), zero("terms")).alias("allowed"),
    )
    finite = ~F.isnan("got") & (F.abs("got") != float("inf"))
    near = F.abs(F.col("got") - F.col("want")) <= F.col("allowed")
    return joined.withColumn("ok", finite & near & ~F.isnan("want"))


def sampled_rows(spark, n: int, wanted: int) -> DataFrame:
    """``wanted`` evenly spaced rows from 0 to n-1 (all rows when n is smaller)."""
    if n <= wanted or wanted < 2:
        return spark.range(n if wanted > 1 else min(n, 1)).select(F.col("id").alias("r"))
    return spark.range(wanted).select(int_div(F.col("id") * (n - 1), wanted - 1).alias("r")).distinct()


def verify(a: Matrix, product: DataFrame, b: Matrix | None = None, sample_rows: int | None = None,
           limits: Limits = Limits()) -> DataFrame:
    """Compare every row of ``product`` with A x B; only with ``sample_rows`` that many spaced rows."""
    entries = a.entries
    if sample_rows is not None:
        rows = sampled_rows(entries.sparkSession, a.n, sample_rows).select(F.col("r").alias("kept_r"))
        keep = lambda cells: lookup(cells, "r", ["c"], rows, "kept_r", limits, min(a.n, sample_rows), "left_semi")
        entries, product = keep(entries), keep(product)
    return compare(reference_product(Matrix(entries, a.n), b or a, limits), product)


def report(compared: DataFrame, total_rows: int, checked_rows: int | None = None) -> DataFrame:
    """One row: cells, mismatches, rows, the largest deviation, and how many rows were checked."""
    return compared.agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(~F.col("ok"), 1)).alias("mismatches"),
        F.count_distinct(F.when(~F.col("ok"), F.col("r"))).alias("bad_rows"),
        F.coalesce(F.max(F.abs(F.col("got") - F.col("want"))), F.lit(0.0)).alias("max_deviation"),
        lng(total_rows if checked_rows is None else min(checked_rows, total_rows)).alias("checked_rows"),
        lng(total_rows).alias("total_rows"),
    )
