"""Compressed-row views of a coordinate matrix and their invariants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.operators.coo import all_rows
from matrel.operators.ordered import BLOCK, running
from matrel.operators.windows import window_of
from matrel.session import stage


def row_pointers(entries: DataFrame, n: int) -> DataFrame:
    """(r, row_nnz, begin_at, end_at) for every row, empty rows included."""
    lengths = entries.groupBy("r").agg(F.count(F.lit(1)).alias("row_nnz"))
    rows = all_rows(entries.sparkSession, n).join(lengths, "r", "left").na.fill(0, ["row_nnz"])
    return running(stage(rows), "r", n, {"begin_at": "row_nnz"}).select(
        "r", "row_nnz", "begin_at", (F.col("begin_at") + F.col("row_nnz")).alias("end_at"))


def packed_rows(entries: DataFrame, width: int = BLOCK) -> DataFrame:
    """(r, w, columns, values): sorted arrays of each row, cut at column windows.

    The cut keeps an array at ``width`` items however long its row is.
    """
    items = F.sort_array(F.collect_list(F.struct("c", "v")))
    return (
        entries.groupBy("r", window_of(F.col("c"), width).alias("w")).agg(items.alias("items"))
        .select("r", "w", F.col("items.c").alias("columns"), F.col("items.v").alias("values"))
    )


def fingerprints(entries: DataFrame) -> DataFrame:
    """(r, row_nnz, fp_xor, fp_sum): two digests of a row's column set, from separate bits of one hash.

    Columns are unique in a row, so the set determines the row's structure;
    both digests combine on the map side.
    """
    digest = F.md5(F.col("c").cast("string"))
    bits = lambda first, digits: F.conv(F.substring(digest, first, digits), 16, 10).cast("long")
    return entries.select("r", bits(1, 15).alias("h1"), bits(17, 10).alias("h2")).groupBy("r").agg(
        F.count(F.lit(1)).alias("row_nnz"), F.bit_xor("h1").alias("fp_xor"), F.sum("h2").alias("fp_sum"))


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose structure differs between two products."""
    a = fingerprints(left)
    b = fingerprints(right).select("r", *[F.col(x).alias(f"other_{x}") for x in ("row_nnz", "fp_xor", "fp_sum")])
    same = F.lit(True)
    for name in ("row_nnz", "fp_xor", "fp_sum"):
        same = same & F.col(name).eqNullSafe(F.col(f"other_{name}"))
    return a.join(b, "r", "full_outer").filter(~same)


def violations(entries: DataFrame, n: int, parts: int = 0) -> DataFrame:
    """Broken invariants of a result: out-of-range indices, duplicates, stored zeros.

    Adaptive execution joins small partitions of an exchange up; ``parts`` keeps that many, so that a task groups a bounded number of cells.
    """
    if parts > 1:
        entries = entries.repartition(max(parts, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "r", "c")
    cells = entries.groupBy("r", "c").agg(F.count(F.lit(1)).alias("copies"), F.max(F.col("v") == 0).alias("zero"))
    inside = F.col("r").between(0, n - 1) & F.col("c").between(0, n - 1)
    problem = (
        F.when(~inside, "out of range").when(F.col("copies") > 1, "duplicate").when(F.col("zero"), "stored zero")
    )
    return cells.withColumn("problem", problem).filter("problem is not null").select("r", "c", "problem")


def descending_steps(packed: DataFrame) -> DataFrame:
    """Packed rows whose columns are not strictly ascending."""
    return packed.filter(F.expr(
        "exists(sequence(1, size(columns) - 1), i -> size(columns) > 1 AND i > 0 AND columns[i] <= columns[i - 1])"
        " AND size(columns) > 1"))
