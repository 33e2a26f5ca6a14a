"""Stored matrices: clustered in two dimensions for ranges, or bucketed on the contraction index for joins.

Clustered. A table sorted by row prunes row ranges only: every row group holds all columns. Here
cells follow the Z-order of (r, c), whose stretches are near-square blocks, so the minima
and maxima that Parquet keeps per row group and page bound both indices, and a filter on a
row range and a column range reaches few groups. Nothing else changes: it is a plain Parquet folder.

Bucketed. A is stored by c and B by r under the same number of buckets, so the join of a
product finds both sides in place: no exchange below it, however often the product is formed
or however many tiles it is cut into. Buckets are stored in order; Spark sorts them again, which costs little on
ordered rows, as it trusts the order of a bucket only under a legacy setting. A key with more pairs than a cell may hold is no case for one
task; such keys are counted when the sides are stored, their cells are kept apart, and they are
joined with cut keys as in ``joins``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.functions.bits import lng
from matrel.operators.coo import Matrix, between
from matrel.operators.joins import JoinShape, Limits, join_shape, lookup
from matrel.operators.multiply import merge_multiply, summed
from matrel.session import new_path, stage
from matrel.sources.matrix_market import file_system

KEY_BITS = 31                      # of each index in a Z-order key
GROUP_BYTES = 16 << 20             # of a row group
CELLS_PER_FILE = 1 << 22           # sorted by one task
CELLS_PER_BUCKET = 1 << 23
_SPREAD = [(16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)]


def with_z_key(entries: DataFrame, n: int, name: str = "z") -> DataFrame:
    """Add the Morton code of (r, c): their bits in turn, the row's first. Larger indices lose their lowest bits."""
    drop = max(0, (n - 1).bit_length() - KEY_BITS)
    parts = []
    for index in ("r", "c"):
        part = f"_{name}_{index}"
        entries = entries.withColumn(part, F.shiftright(index, drop))
        for shift, mask in _SPREAD:                # each step reads the one before twice, so each is a projection
            entries = entries.withColumn(part, F.col(part).bitwiseOR(F.shiftleft(part, shift)).bitwiseAND(lng(mask)))
        parts.append(part)
    return entries.withColumn(name, F.shiftleft(parts[0], 1).bitwiseOR(F.col(parts[1]))).drop(*parts)


def write_clustered(matrix: Matrix, path: str, group_bytes: int = GROUP_BYTES, cells_per_file: int = CELLS_PER_FILE) -> None:
    """Store the cells in Z-order, in row groups of about ``group_bytes``.

    The entries are read twice (sampled for the ranges of the keys, then dealt); stage a costly one first.
    """
    files = max(1, -(-matrix.entries.count() // cells_per_file))
    keyed = with_z_key(matrix.entries.select("r", "c", "v"), matrix.n)
    dealt = keyed.repartitionByRange(files, "z").sortWithinPartitions("z").drop("z")
    # the reader decides by groups, the writer looks at its size every ``row.check`` rows
    dealt.write.option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, group_bytes // 16)).option(
        "parquet.page.size.row.check.max", 1000).option("parquet.block.size.row.check.max", 1000).parquet(path)


def read_clustered(spark: SparkSession, path: str, n: int, rows: tuple[int | None, int | None] = (None, None),
                   columns: tuple[int | None, int | None] = (None, None)) -> Matrix:
    """The cells of half-open row and column ranges; both filters are decided by the statistics of the row groups."""
    return Matrix(spark.read.parquet(path).filter(between("r", *rows) & between("c", *columns)), n)


def group_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, cells, r_min, r_max, c_min, c_max) of a stored matrix, from the footers of its files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                system, inner = file_system(name)
                with system.open_input_file(inner) as file:
                    footer = pq.read_metadata(file)
                at = {footer.schema.column(i).name: i for i in range(footer.num_columns)}
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    r, c = (group.column(at[x]).statistics for x in "rc")
                    rows.append((name, g, group.num_rows, r.min, r.max, c.min, c.max))
            kinds = [pa.string(), pa.int32(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                             names=["file", "row_group", "cells", "r_min", "r_max", "c_min", "c_max"])

    files = spark.createDataFrame([(f,) for f in spark.read.parquet(path).inputFiles()], "file string")
    return files.mapInArrow(run, "file string, row_group int, cells long, r_min long, r_max long, c_min long, c_max long")


def met_groups(bounds: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The row groups of ``group_bounds`` that a range of rows and columns has to read."""
    return bounds.filter((F.col("r_min") < rows[1]) & (F.col("r_max") >= rows[0]) & (F.col("c_min") < columns[1]) & (F.col("c_max") >= columns[0]))


# --- buckets -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class CoPartitioned:
    """Factors stored for their product: tables of A by c and of B by r, and the cells of hot keys."""

    left: str
    right: str
    hot_left: DataFrame
    hot_right: DataFrame
    shape: JoinShape
    n: int


def _bucketed(entries: DataFrame, key: str, buckets: int, path: str) -> str:
    spark = entries.sparkSession
    name = f"matrel_{uuid.uuid4().hex}"
    # one task per bucket writes one file per bucket
    entries.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return name


def co_partition(a: Matrix, b: Matrix | None = None, buckets: int | None = None, limits: Limits = Limits()) -> CoPartitioned:
    """Store A by c and B (default A) by r as external tables of the session, below the shared folder.

    ``drop`` removes them. The number of buckets follows the larger side and the pairs.
    """
    b = b or a
    spark = a.entries.sparkSession
    shape = join_shape(a.entries, "c", b.entries, "r", limits)
    buckets = buckets or max(shape.partitions(limits), -(-max(shape.left_rows, shape.right_rows) // CELLS_PER_BUCKET))
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    hot = stage(shape.degrees.filter(pairs > limits.pairs_per_cell).select(F.col("k").alias("hot_k")))
    split = lambda entries, key, identity, how: lookup(entries.select("r", "c", "v"), key, identity, hot, "hot_k", limits, shape.hot_keys, how)
    left = _bucketed(split(a.entries, "c", ["r"], "left_anti"), "c", buckets, new_path(spark, "bucketed"))
    right = _bucketed(split(b.entries, "r", ["c"], "left_anti"), "r", buckets, new_path(spark, "bucketed"))
    hot_left, hot_right = stage(split(a.entries, "c", ["r"], "left_semi")), stage(split(b.entries, "r", ["c"], "left_semi"))
    return CoPartitioned(left, right, hot_left, hot_right, shape, a.n)


def drop(stored: CoPartitioned, spark: SparkSession) -> None:
    for name in (stored.left, stored.right):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def co_partitioned_products(stored: CoPartitioned, spark: SparkSession, rows: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """(r, c, p) of all keys that are not hot: a merge join of two bucketed tables, nothing exchanged below it."""
    a = spark.table(stored.left).filter(between("r", *rows)).select("r", F.col("c").alias("k"), F.col("v").alias("va"))
    b = spark.table(stored.right).select(F.col("r").alias("kb"), "c", F.col("v").alias("vb")).hint("merge")
    return a.join(b, F.col("k") == F.col("kb")).select("r", "c", (F.col("va") * F.col("vb")).alias("p"))


def co_partitioned_multiply(stored: CoPartitioned, spark: SparkSession, rows: tuple[int | None, int | None] = (None, None),
                            keep_structural: bool = False, limits: Limits = Limits()) -> DataFrame:
    """The product of stored factors as (r, c, v)."""
    products = co_partitioned_products(stored, spark, rows)
    if stored.shape.hot_keys:
        hot = merge_multiply(stored.hot_left.filter(between("r", *rows)), stored.hot_right, True, limits)
        products = products.unionByName(hot.withColumnRenamed("v", "p"))
    return summed(products, keep_structural, parts=stored.shape.partitions(limits))
