"""Running values over an ordered index without one global sorted task.

Rows are cut into blocks of consecutive index values. Each block is reduced
(combined on the map side), the block totals are scanned, and every block then
scans its own rows from its offset. When the index range has more blocks than
one task should scan, the block totals are scanned the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrel.functions.bits import int_div, lng

BLOCK = 1 << 16


def running(df: DataFrame, order: str, extent: int, sums: dict[str, str] | None = None,
            maxima: dict[str, str] | None = None, within: tuple[str, ...] = (),
            block: int = BLOCK) -> DataFrame:
    """Add exclusive running sums and maxima along ``order``.

    ``order`` is a LONG in [0, extent), unique inside each ``within`` group, so
    a block holds at most ``block`` rows however large its group is. ``sums``
    and ``maxima`` map new column names to value columns; the first row of a
    group gets 0 and NULL. ``df`` is read twice, so a costly one should be staged.
    """
    sums, maxima = sums or {}, maxima or {}
    blocks = df.withColumn("_block", int_div(F.col(order), block))
    keys = [*within, "_block"]
    totals = blocks.groupBy(*keys).agg(
        *[F.sum(v).alias(f"_t_{name}") for name, v in sums.items()],
        *[F.max(v).alias(f"_t_{name}") for name, v in maxima.items()],
    )
    inner_sums = {f"_o_{n}": f"_t_{n}" for n in sums}
    inner_max = {f"_o_{n}": f"_t_{n}" for n in maxima}
    n_blocks = -(-extent // block)
    if n_blocks > block:
        totals = running(totals.withColumnRenamed("_block", "_outer"), "_outer", n_blocks,
                         inner_sums, inner_max, within, block).withColumnRenamed("_outer", "_block")
    else:
        before = Window.partitionBy(*within).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        for name, value in inner_sums.items():
            totals = totals.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
        for name, value in inner_max.items():
            totals = totals.withColumn(name, F.max(value).over(before))
    offsets = totals.select(*keys, *inner_sums, *inner_max)
    joined = blocks.join(offsets, keys)
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    for name, value in sums.items():
        local = F.coalesce(F.sum(value).over(inside), F.lit(0))
        joined = joined.withColumn(name, F.col(f"_o_{name}") + local)
    for name, value in maxima.items():
        local = F.max(value).over(inside)
        joined = joined.withColumn(name, F.greatest(F.col(f"_o_{name}"), local))
    return joined.drop("_block", *inner_sums, *inner_max)


def rank_within(df: DataFrame, order: str, extent: int, within: tuple[str, ...],
                name: str = "pos", block: int = BLOCK) -> DataFrame:
    """0-based position of each row inside its ``within`` group, by ``order``."""
    counted = df.withColumn("_one", lng(1))
    return running(counted, order, extent, {name: "_one"}, within=within, block=block).drop("_one")
