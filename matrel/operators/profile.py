"""Row statistics of a product, taken without forming any product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions import sketch
from matrel.functions.bits import floor_log2, int_div, lng
from matrel.functions.sketch import SketchKind
from matrel.operators.coo import Matrix, all_rows
from matrel.operators.joins import Limits, lookup

# Bins of products and of reuse.
PRODUCT_BINS = 8
REUSE_BINS = 6
REUSE_EDGES = (0.5, 1.0, 2.0, 4.0, 8.0)


def b_row_stats(b: DataFrame) -> DataFrame:
    """Length and first/last column of every non-empty row of B."""
    return b.groupBy(F.col("r").alias("bk")).agg(
        F.count(F.lit(1)).alias("run"), F.min("c").alias("first_c"), F.max("c").alias("last_c")
    )


def feature_bin(products, lower_bound):
    product_bin = F.least(lng(PRODUCT_BINS - 1), int_div(floor_log2(F.least(products, lng(1 << 40))).cast("long"), 3))
    reuse_bin = sum((F.when(lower_bound >= edge, 1).otherwise(0) for edge in REUSE_EDGES), F.lit(0))
    return (product_bin * REUSE_BINS + reuse_bin).cast("int")


def row_features(a: Matrix, b: Matrix | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row per matrix row: runs, products, max_run, column range, span, lower bound, bin.

    Rows without products keep zero ranges and bin 0. Cost is one pass over A
    against one statistic per row of B.
    """
    b = b or a
    entries = a.entries.select("r", F.col("c").alias("k"))
    stats = b_row_stats(b.entries)
    touched = lookup(entries, "k", ["r"], stats, "bk", limits, b.n, "left").groupBy("r").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("run").alias("products"), F.max("run").alias("max_run"),
        F.min("first_c").alias("min_col"), F.max("last_c").alias("max_col"),
    )
    zero = lambda name: F.coalesce(F.col(name), lng(0)).alias(name)
    span = F.when(F.col("products") > 0, F.col("max_col") - F.col("min_col") + 1).otherwise(lng(0))
    bound = F.when(F.col("products") > 0, F.col("products").cast("double") / F.col("span")).otherwise(0.0)
    return (
        all_rows(a.entries.sparkSession, a.n)
        .join(touched, "r", "left")
        .select("r", *[zero(x) for x in ("runs", "products", "max_run", "min_col", "max_col")])
        .withColumn("span", span)
        .withColumn("lower_bound", bound)
        .withColumn("bin", F.when(F.col("products") > 0, feature_bin(F.col("products"), F.col("lower_bound"))).otherwise(0))
    )


def row_sketches(entries: DataFrame, kind: SketchKind) -> DataFrame:
    """Length and column sketch of every non-empty row: (bk, run, h0 ..)."""
    ranked = sketch.with_rank(entries.select(F.col("r").alias("bk"), "c"), F.col("c"), kind)
    return ranked.groupBy("bk").agg(F.count(F.lit(1)).alias("run"), *sketch.build(kind))


def sketch_rows(entries: DataFrame, kind: SketchKind) -> DataFrame:
    """Long form of the row sketches: (r, register, rank) for touched registers."""
    ranked = sketch.with_rank(entries.select("r", "c"), F.col("c"), kind)
    return ranked.groupBy("r", "register").agg(F.max("rank").alias("rank"))


def output_estimates(entries: DataFrame, b: Matrix, kind: SketchKind, limits: Limits = Limits()) -> DataFrame:
    """Estimated distinct output columns of each row of ``entries``: (r, products, estimate)."""
    leaves = row_sketches(b.entries, kind)
    joined = lookup(entries.select("r", F.col("c").alias("k")), "k", ["r"], leaves, "bk", limits, b.n)
    merged = joined.groupBy("r").agg(F.sum("run").alias("products"), *sketch.merge(kind))
    upper = F.least(F.col("products"), lng(b.n))
    return merged.select("r", "products", sketch.estimate(upper, kind).alias("estimate"))
