"""Contiguous row batches under budgets, and islands of batchable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import int_div, lng
from matrel.operators.joins import Limits, lookup
from matrel.operators.ordered import rank_within, running
from matrel.session import stage

# Default budgets and the island limits.
OUTPUT_ITEM_BUDGET = 120_000_000
TASK_BUDGET = 15_000_000
PRODUCT_BUDGET = 150_000_000
WORD_BUDGET = (240 << 20) // 64
ISLAND_MIN_TASKS = 2
ISLAND_MAX_TASKS = 180
ISLAND_MAX_ROWS = 64
ISLAND_MIN_ROWS = 4
ISLAND_MIN_PRODUCTS = 512


def _cut_after(rows: DataFrame, n: int, weight: str, budget: int, total: int, limits: Limits) -> DataFrame:
    """First row where a batch started at ``r`` would exceed one budget: (r, cut).

    A batch started at prefix p ends at the first row whose inclusive prefix
    exceeds p + budget. Prefixes and limits are laid on one axis, largest
    first, and a running maximum finds the nearest prefix above each limit.
    """
    extent = 2 * (total + budget + 2)
    at = lambda key: (lng(total + budget) - key) * 2
    points = rows.filter(F.col(weight) > 0).select(
        (at(F.col(f"p_{weight}") + F.col(weight)) + 1).alias("x"), (-F.col("r")).alias("minus_r"),
        F.lit(None).cast("long").alias("limit"))
    limit = F.col(f"p_{weight}") + lng(budget)
    questions = rows.select(limit.alias("limit")).distinct().select(
        at(F.col("limit")).alias("x"), F.lit(None).cast("long").alias("minus_r"), "limit")
    answered = running(points.unionByName(questions), "x", extent, maxima={"nearest": "minus_r"})
    answers = answered.filter(F.col("limit").isNotNull() & F.col("nearest").isNotNull()).select(
        "limit", (-F.col("nearest")).alias("found"))
    marked = rows.select("r", limit.alias("limit_of_r"))
    cut = lookup(marked, "limit_of_r", ["r"], answers, "limit", limits, n)
    return cut.select("r", F.greatest(F.col("found"), F.col("r") + 1).alias("cut"))


def row_batches(rows: DataFrame, n: int, budgets: dict[str, int], even: bool = False,
                limits: Limits = Limits()) -> DataFrame:
    """Greedy contiguous batches over rows 0..n-1: (batch, begin_row, end_row, <weights>).

    A batch closes before the first row that would exceed any budget; a single
    row over budget forms its own batch. ``even`` moves an odd boundary up by
    one row so that aligned row pairs stay together.

    Every row points at the start that would follow it. The starts reachable
    from row 0 are collected by doubling those pointers, so the sequential
    chain costs log2(batches) joins instead of one pass through one task.
    """
    weights = list(budgets)
    table = stage(running(rows.select("r", *weights), "r", n, {f"p_{w}": w for w in weights}))
    totals = table.agg(*[F.coalesce(F.sum(w), lng(0)).alias(w) for w in weights]).first()
    cuts = None
    for weight in weights:
        if totals[weight] > budgets[weight]:
            found = _cut_after(table, n, weight, budgets[weight], totals[weight], limits)
            cuts = found if cuts is None else cuts.unionByName(found)
    starts = rows.sparkSession.range(1).select(F.col("id").alias("s"))
    jumps = None
    if cuts is not None:
        after = cuts.groupBy("r").agg(F.min("cut").alias("to"))
        if even:
            after = after.withColumn("to", F.col("to") + F.col("to") % 2)
        jumps = stage(after.filter(F.col("to") < n))      # rows without a jump close the last batch
        leap, known = jumps, 1
        while True:
            fresh = lookup(leap, "r", ["r"], starts, "s", limits, n).select(F.col("to").alias("s"))
            starts = stage(starts.unionByName(fresh).distinct())
            count, known = starts.count(), known * 2
            if count < known:
                break
            on = leap.select(F.col("r").alias("from"), F.col("to").alias("via"))
            leap = stage(lookup(on, "via", ["from"], leap, "r", limits, n).select(F.col("from").alias("r"), "to"))
    bounds = starts.withColumnRenamed("s", "begin_row")
    if jumps is None:
        bounds = bounds.withColumn("end_row", lng(n))
    else:
        bounds = bounds.join(jumps.withColumnRenamed("r", "begin_row"), "begin_row", "left").select(
            "begin_row", F.coalesce("to", lng(n)).alias("end_row"))
    numbered = rank_within(bounds, "begin_row", n, (), "batch")
    prefix = lambda side: table.select(F.col("r").alias(f"{side}_row"), *[F.col(f"p_{w}").alias(f"{side}_{w}") for w in weights])
    ends = numbered.join(prefix("begin"), "begin_row").join(prefix("end"), "end_row", "left")
    return ends.select(
        "batch", "begin_row", "end_row",
        *[(F.coalesce(F.col(f"end_{w}"), lng(totals[w])) - F.col(f"begin_{w}")).alias(w) for w in weights],
    )


def merge_islands(rows: DataFrame, n: int) -> DataFrame:
    """Consecutive batchable MERGE rows in chunks of 64: (first_row, n_rows, products, selected).

    ``rows`` has (r, route, tasks, products) for every row. The island start is
    the row after the last unsuitable one, found by a running maximum.
    """
    suits = (
        (F.col("route") == 2) & F.col("tasks").between(ISLAND_MIN_TASKS, ISLAND_MAX_TASKS)
        & (F.col("products") > 0)
    )
    marked = rows.select("r", "products", suits.alias("suits")).withColumn(
        "gap", F.when(~F.col("suits"), F.col("r")))
    placed = running(marked, "r", n, maxima={"last_gap": "gap"}).filter("suits")
    island = F.coalesce("last_gap", lng(-1)) + 1
    chunk = placed.select(
        "r", "products", (island + int_div(F.col("r") - island, ISLAND_MAX_ROWS) * ISLAND_MAX_ROWS).alias("first_row"))
    return (
        chunk.groupBy("first_row")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("products").alias("products"))
        .withColumn("selected", (F.col("n_rows") >= ISLAND_MIN_ROWS) & (F.col("products") >= ISLAND_MIN_PRODUCTS))
    )


def island_summary(islands: DataFrame) -> DataFrame:
    """One row: selected batches, their rows and products, and the rows left to the fallback."""
    chosen = F.col("selected")
    return islands.agg(
        F.count(F.when(chosen, 1)).alias("batches"),
        F.coalesce(F.sum(F.when(chosen, F.col("n_rows"))), lng(0)).alias("selected_rows"),
        F.coalesce(F.sum(F.when(chosen, F.col("products"))), lng(0)).alias("selected_products"),
        F.coalesce(F.sum(F.when(~chosen, F.col("n_rows"))), lng(0)).alias("fallback_rows"),
    )
