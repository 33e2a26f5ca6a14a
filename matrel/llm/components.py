"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.session import discard, stage


def _print(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges, to see that a round changed nothing."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("u")).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = down.join(least, F.col("a") == F.col("u"))
    pairs = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)`` except the smallest of each component.

    The component is the smallest node reachable. Both steps point each node at the least
    neighbour it knows of; the edges end as one star per component. Each round is staged, so
    the lineage stays short, and the round before is deleted; only a checksum comes to the driver.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct())
    before = None
    while True:
        now = _print(edges)
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        last, edges = edges, stage(_small_star(_large_star(edges)))
        discard(last)
