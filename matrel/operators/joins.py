"""Equi-joins whose hot keys are split into bounded cells.

One key may hold a third of all rows on either side. The key's rectangle of
(left rows) x (right rows) pairs is cut into cells: left rows are spread over
``cut_l`` salts and right rows over ``cut_r`` salts, and each side is repeated
once per salt of the other. Every pair meets in exactly one cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import lng
from matrel.session import stage

BROADCAST_VALUES = 4_000_000   # 8-byte values of a broadcast side: counted first, never more
PAIRS_PER_CELL = 1 << 22       # a key with more pairs than this is cut
PAIRS_PER_TASK = 1 << 22       # sizing of the join's partitions
ROWS_PER_TASK = 1 << 22        # input rows of one side: bounds the hash table of a task
VALUES_PER_TASK = 1 << 22      # 8-byte values of a hash table: about 150 MB in memory that cannot be spilled
MAX_CUT = 1 << 16              # bounds the copies made of one row
MAX_PARTITIONS = 200_000


@dataclass(frozen=True)
class Limits:
    broadcast_values: int = BROADCAST_VALUES
    pairs_per_cell: int = PAIRS_PER_CELL
    pairs_per_task: int = PAIRS_PER_TASK
    rows_per_task: int = ROWS_PER_TASK

    def broadcasts(self, rows: int, df: DataFrame) -> bool:
        """Whether ``rows`` rows of ``df`` are few enough to send to every executor."""
        return rows * len(df.columns) <= self.broadcast_values


@dataclass(frozen=True)
class JoinShape:
    left_rows: int
    right_rows: int
    pairs: float
    hot_keys: int
    degrees: DataFrame
    longest: int | None = None       # most pairs of one left row's group, where known
    widest: int = 0                  # most right rows of one key

    def partitions(self, limits: Limits) -> int:
        spark = self.degrees.sparkSession
        wanted = max(math.ceil(self.pairs / limits.pairs_per_task), -(-max(self.left_rows, self.right_rows) // limits.rows_per_task))
        if wanted > MAX_PARTITIONS:
            raise ValueError(f"{self.pairs:.3g} pairs of {self.left_rows} and {self.right_rows} rows need {wanted} tasks; raise Limits.pairs_per_task or restrict the rows")
        return max(spark.sparkContext.defaultParallelism, wanted)

    def hint(self, limits: Limits) -> str:
        """Either keeps Spark from broadcasting a side for its small compressed size.

        A hash table cannot spill, so it is built only where no key alone outgrows a task.
        """
        return "shuffle_hash" if self.widest <= limits.rows_per_task else "merge"


def join_shape(left: DataFrame, left_key: str, right: DataFrame, right_key: str,
               limits: Limits = Limits()) -> JoinShape:
    """Rows, pairs and hot keys of a join, from one aggregation over the keys."""
    both = left.select(F.col(left_key).alias("k"), lng(1).alias("left_rows"), lng(0).alias("right_rows")).unionAll(
        right.select(F.col(right_key).alias("k"), lng(0).alias("left_rows"), lng(1).alias("right_rows"))
    )
    degrees = both.groupBy("k").agg(
        F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows")
    )
    pairs = F.col("left_rows").cast("double") * F.col("right_rows")
    row = degrees.agg(
        F.coalesce(F.sum("left_rows"), lng(0)).alias("l"),
        F.coalesce(F.sum("right_rows"), lng(0)).alias("r"),
        F.coalesce(F.sum(pairs), F.lit(0.0)).alias("p"),
        F.count(F.when(pairs > limits.pairs_per_cell, 1)).alias("hot"),
        F.coalesce(F.max("right_rows"), lng(0)).alias("widest"),
    ).first()
    return JoinShape(row["l"], row["r"], row["p"], row["hot"], degrees, widest=row["widest"])


def cuts_of(shape: JoinShape, limits: Limits) -> DataFrame:
    """Hot keys with the number of salts of each side.

    Cells are square where both sides allow it, since that copies the fewest
    rows; a side shorter than the cell's edge stays whole.
    """
    edge = float(math.isqrt(limits.pairs_per_cell))
    left, right = F.col("left_rows").cast("double"), F.col("right_rows").cast("double")
    other = lambda side: F.lit(float(limits.pairs_per_cell)) / F.least(side, F.lit(edge))
    cut = lambda rows, opposite: F.greatest(lng(1), F.ceil(rows / other(opposite)).cast("long"))
    pairs = left * right
    return shape.degrees.filter(pairs > limits.pairs_per_cell).select(
        F.col("k").alias("hot_k"), cut(left, right).alias("cut_l"), cut(right, left).alias("cut_r")
    )


def _salted(df: DataFrame, key: str, identity: list[str], cuts: DataFrame, own: str, other: str,
            names: tuple[str, str]) -> DataFrame:
    own_salt, other_salt = names
    marked = df.join(cuts, F.col(key) == F.col("hot_k"), "left")
    spread = F.pmod(F.xxhash64(*identity), F.coalesce(F.col(own), lng(1)))
    copies = F.explode(F.sequence(lng(0), F.coalesce(F.col(other), lng(1)) - 1))
    return (
        marked.withColumn(own_salt, spread)
        .withColumn(other_salt, copies)
        .drop("hot_k", "cut_l", "cut_r")
    )


def spread_join(left: DataFrame, left_key: str, left_identity: list[str],
                right: DataFrame, right_key: str, right_identity: list[str],
                shape: JoinShape | None = None, limits: Limits = Limits(),
                spread_by: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Join on one key each; column names of the sides must not overlap.

    * right side counted and small: broadcast it, and spread the left rows by
      ``spread_by`` over enough tasks for the pairs they produce;
    * otherwise shuffle both sides by key, hot keys cut into cells. The number
      of partitions follows the pairs, because the join multiplies its input, and
      the rows, because many rows may meet in few pairs.
    """
    shape = shape or join_shape(left, left_key, right, right_key, limits)
    parts = shape.partitions(limits)
    on: Column = F.col(left_key) == F.col(right_key)
    if limits.broadcasts(shape.right_rows, right):
        if spread_by:
            left = left.repartition(parts, *spread_by)
        return left.join(F.broadcast(right), on, how)
    parts = max(parts, min(MAX_PARTITIONS, -(-shape.right_rows * len(right.columns) // VALUES_PER_TASK)))
    if shape.hot_keys == 0:
        right = right.repartition(parts, right_key).hint(shape.hint(limits))
        return left.repartition(parts, left_key).join(right, on, how)
    cuts = stage(cuts_of(shape, limits))
    if cuts.filter((F.col("cut_l") > MAX_CUT) | (F.col("cut_r") > MAX_CUT)).limit(1).count():
        raise ValueError("one key needs more salts than MAX_CUT; raise Limits.pairs_per_cell")
    if limits.broadcasts(shape.hot_keys, cuts):
        cuts = F.broadcast(cuts)
    lhs = _salted(left, left_key, left_identity, cuts, "cut_l", "cut_r", ("salt_l", "salt_r"))
    rhs = _salted(right, right_key, right_identity, cuts, "cut_r", "cut_l", ("salt_r2", "salt_l2"))
    lhs = lhs.repartition(parts, left_key, "salt_l", "salt_r")
    rhs = rhs.repartition(parts, right_key, "salt_l2", "salt_r2").hint(shape.hint(limits))
    on = on & (F.col("salt_l") == F.col("salt_l2")) & (F.col("salt_r") == F.col("salt_r2"))
    return lhs.join(rhs, on, how).drop("salt_l", "salt_r", "salt_l2", "salt_r2")


def balanced(rows: DataFrame, group: str, key: str, shape: JoinShape, limits: Limits) -> bool:
    """Whether no ``group`` of the left rows makes more than a quarter of one task's share of the pairs."""
    if shape.longest is not None:
        return shape.longest * 4 <= shape.pairs / shape.partitions(limits)
    met = shape.degrees.filter("right_rows > 0").select(F.col("k").alias("met_k"), "right_rows")
    if limits.broadcasts(shape.right_rows, met):
        met = F.broadcast(met)             # no more keys than counted rows
    made = rows.join(met, F.col(key) == F.col("met_k")).groupBy(group).agg(F.sum("right_rows").alias("made"))
    longest = made.agg(F.max("made")).first()[0] or 0
    return longest * 4 <= shape.pairs / shape.partitions(limits)


def lookup(left: DataFrame, left_key: str, left_identity: list[str], right: DataFrame,
           right_key: str, limits: Limits = Limits(), right_bound: int | None = None,
           how: str = "inner") -> DataFrame:
    """Join with a side that has one row per key (statistics, sketches, routes).

    ``right_bound`` is a proven upper bound of its rows, usually the matrix
    size; where it is small the side is broadcast without being counted.
    Left, semi and anti joins are safe: only keys of both sides are cut, and a
    side with one row per key is never cut itself.
    """
    rows = right.count() if right_bound is None else right_bound
    if limits.broadcasts(rows, right):
        return left.join(F.broadcast(right), F.col(left_key) == F.col(right_key), how)
    return spread_join(left, left_key, left_identity, right, right_key, [right_key], limits=limits, how=how)
