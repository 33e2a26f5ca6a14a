"""Clustered and bucketed storage: results, pruning and plans."""

import random

import pytest
from conftest import brute_product, cells_of
from pyspark.sql import functions as F

from matrel import multiply, storage
from matrel.operators.coo import Matrix
from matrel.operators.joins import Limits
from matrel.session import stage


def morton(r, c):
    return sum(((r >> i & 1) << (2 * i + 1)) | ((c >> i & 1) << (2 * i)) for i in range(31))


def test_z_key(spark):
    rnd = random.Random(2)
    cells = [(rnd.randrange(1 << k), rnd.randrange(1 << k), 1.0) for k in range(1, 32) for _ in range(4)] + [((1 << 31) - 1, (1 << 31) - 1, 1.0)]
    df = spark.createDataFrame(cells, "r long, c long, v double")
    assert all(x["z"] == morton(x["r"], x["c"]) for x in storage.with_z_key(df, 1 << 31).collect())
    big = spark.createDataFrame([((1 << 40) + 5, 3 << 20, 1.0)], "r long, c long, v double")
    row = storage.with_z_key(big, 1 << 41).first()
    assert row["z"] == morton(((1 << 40) + 5) >> 10, (3 << 20) >> 10) and list(row.asDict()) == ["r", "c", "v", "z"]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    n = 1024
    cells = spark.range(200_000).select(
        F.pmod(F.xxhash64("id"), F.lit(n)).alias("r"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).alias("c"), F.col("id").cast("double").alias("v"))
    m = Matrix(stage(cells.groupBy("r", "c").agg(F.sum("v").alias("v"))), n)
    base = tmp_path_factory.mktemp("stored")
    clustered, sorted_ = str(base / "clustered"), str(base / "sorted")
    storage.write_clustered(m, clustered, group_bytes=20_000, cells_per_file=60_000)
    m.entries.repartitionByRange(4, "r").sortWithinPartitions("r", "c").write.option("parquet.block.size", 20_000).option(
        "parquet.page.size.row.check.max", 1000).parquet(sorted_)
    return m, clustered, sorted_


def scanned(df):
    """Rows that the scan of a query without exchanges has put out, from its metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_range_reads_few_groups(spark, stored):
    m, clustered, sorted_ = stored
    rows, columns = (512, 640), (256, 384)
    want = cells_of(m.entries.filter((F.col("r") >= 512) & (F.col("r") < 640) & (F.col("c") >= 256) & (F.col("c") < 384)))
    got = storage.read_clustered(spark, clustered, m.n, rows, columns).entries
    assert cells_of(got) == want and want
    groups = {name: storage.group_bounds(spark, path) for name, path in (("clustered", clustered), ("sorted", sorted_))}
    total = {k: g.count() for k, g in groups.items()}
    met = {k: storage.met_groups(g, rows, columns).count() for k, g in groups.items()}
    assert min(total.values()) >= 40 and met["clustered"] * 4 <= met["sorted"]
    assert {k: g.agg(F.sum("cells")).first()[0] for k, g in groups.items()} == dict.fromkeys(groups, m.entries.count())
    # what the scans themselves say
    plain = storage.read_clustered(spark, sorted_, m.n, rows, columns).entries
    assert scanned(got) * 3 < scanned(plain) and cells_of(plain) == want


def test_columns_prune_the_right_side_of_a_window(spark, stored):
    m, clustered, _ = stored
    right = storage.read_clustered(spark, clustered, m.n)
    window = (0, 64)
    some = Matrix(m.entries.filter("r < 8"), m.n)
    got = multiply(some, right, mode="merge", columns=window)
    assert cells_of(got) == cells_of(multiply(some, m, mode="merge", columns=window))
    assert storage.met_groups(storage.group_bounds(spark, clustered), (0, m.n), window).count() * 4 < storage.group_bounds(spark, clustered).count()


@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_values=0, pairs_per_cell=60)])
def test_bucketed_product(spark, matrix_of, limits):
    rnd = random.Random(9)
    cells = {(rnd.randrange(40), rnd.choice([3, rnd.randrange(40)])): rnd.randrange(1, 9) for _ in range(260)}
    cells.update({(3, c): 2 for c in range(40)})
    cells = [(r, c, v) for (r, c), v in cells.items()]
    stored = storage.co_partition(matrix_of(cells, 40), buckets=5, limits=limits)
    assert (stored.shape.hot_keys > 0) == (limits.pairs_per_cell == 60) == (stored.hot_left.count() > 0)
    want = brute_product(cells, cells)
    assert cells_of(storage.co_partitioned_multiply(stored, spark, limits=limits)) == want
    part = storage.co_partitioned_multiply(stored, spark, rows=(5, 17), limits=limits)
    assert cells_of(part) == {k: v for k, v in want.items() if 5 <= k[0] < 17}
    storage.drop(stored, spark)
    assert not spark.catalog.tableExists(stored.left)


def test_nothing_is_exchanged_below_the_bucketed_join(spark, tables):
    stored = storage.co_partition(tables.matrix("part"), buckets=4)
    plan = storage.co_partitioned_products(stored, spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    storage.drop(stored, spark)


def test_other_factor_and_empty_matrices(spark, matrix_of):
    a, b = [(0, 1, 2), (2, 2, 3)], [(1, 0, 5), (2, 1, 7)]
    stored = storage.co_partition(matrix_of(a, 3), matrix_of(b, 3), buckets=2)
    assert cells_of(storage.co_partitioned_multiply(stored, spark)) == brute_product(a, b)
    empty = Matrix(spark.createDataFrame([], "r long, c long, v double"), 3)
    stored = storage.co_partition(empty, matrix_of(b, 3), buckets=2)
    assert storage.co_partitioned_multiply(stored, spark).collect() == []
