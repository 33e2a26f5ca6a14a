"""Features, sketches, routes and planners."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matrel.functions.bits import bit_length, with_hash32
from matrel.functions.sketch import HLL16, HLL32
from matrel.operators import profile
from matrel.operators.coo import Matrix
from matrel.operators.joins import Limits
from matrel.plans import light

MASK = 0xFFFFFFFF


def hash_of(value):
    x = (value + 0x9E3779B9) & MASK
    x = ((x ^ (x >> 16)) * 0x85EBCA6B) & MASK
    x = ((x ^ (x >> 13)) * 0xC2B2AE35) & MASK
    return x ^ (x >> 16)


def sketch_of(columns, kind):
    registers = [0] * kind.registers
    for c in columns:
        h = hash_of(c)
        rest = h >> kind.index_bits
        rank = 31 if rest == 0 else kind.rank_bits + 1 - rest.bit_length()
        registers[h % kind.registers] = max(registers[h % kind.registers], rank)
    return registers


def estimate_of(registers, upper, kind):
    if upper == 0:
        return 0
    m, zeros = kind.registers, registers.count(0)
    value = kind.alpha * m * m / sum(2.0**-x for x in registers)
    if value <= 2.5 * m and zeros:
        value = m * math.log(m / zeros)
    return max(1, min(upper, math.floor(value + 0.5)))


@pytest.fixture(scope="module")
def hub(spark):
    """Rows 0..199 hold columns 0..39; rows 0..39 also hold the last column: sampling decides."""
    body = spark.range(200 * 40).select((F.col("id") / 40).cast("long").alias("r"), (F.col("id") % 40).alias("c"), F.lit(1.0).alias("v"))
    last = spark.range(40).select(F.col("id").alias("r"), F.lit(1599).cast("long").alias("c"), F.lit(1.0).alias("v"))
    return Matrix(body.unionByName(last), 1600)


def test_hash_and_bit_length(spark):
    values = list(range(2000)) + [2**31, 2**32 - 1, 123456789]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    for row in with_hash32(df, F.col("x"), "h").collect():
        assert row["h"] == hash_of(row["x"])
    powers = [0] + [p + d for k in range(1, 45) for p in [1 << k] for d in (-1, 0)]
    got = spark.createDataFrame([(p,) for p in powers], "x long").select("x", bit_length(F.col("x")).alias("b")).collect()
    assert all(r["b"] == r["x"].bit_length() for r in got)


@pytest.mark.parametrize("kind", [HLL16, HLL32])
@pytest.mark.parametrize("limits", [Limits(), Limits(broadcast_values=0, pairs_per_cell=16)])
def test_estimates(matrix_of, kind, limits):
    rng = random.Random(3)
    cells = {(rng.randrange(40), rng.randrange(40)) for _ in range(300)}
    m = matrix_of([(r, c, 1) for r, c in cells], 40)
    by_row = {}
    for r, c in cells:
        by_row.setdefault(r, set()).add(c)
    got = {r["r"]: (r["products"], r["estimate"]) for r in profile.output_estimates(m.entries, m, kind, limits).collect()}
    for r, ks in by_row.items():
        runs = [by_row.get(k, set()) for k in ks]
        products = sum(map(len, runs))
        if products:
            union = sketch_of(set().union(*runs), kind)
            assert got[r] == (products, estimate_of(union, min(products, 40), kind))


def test_sampling_decides_the_hub(hub):
    plan = light.choose_routes(hub)
    row = plan.summary().first()
    assert (row["dense_rows"], row["empty_rows"], row["sampled_rows"]) == (200, 1400, 6)
    assert (row["light_mode"], row["policy_mode"]) == ("DENSE_ONLY", "MERGE_ONLY")
    sample = plan.samples.first()
    assert (sample["bin"], sample["estimate"]) == (20, 44)
    off = light.choose_routes(hub, options=light.LightOptions(enable_sampling=False)).summary().first()
    assert (off["merge_rows"], off["dense_rows"]) == (200, 0)


def test_hub_product(hub):
    from matrel import multiply

    merge, dense = multiply(hub, mode="merge"), multiply(hub, mode="dense")
    assert merge.count() == 8200 and dense.exceptAll(merge).count() == 0 and merge.exceptAll(dense).count() == 0
    row = {r["c"]: r["v"] for r in multiply(hub, mode="adaptive").filter("r = 0").collect()}
    assert row == {**{c: 40.0 for c in range(40)}, 1599: 40.0}


def test_lone_dense_rows_are_demoted(spark):
    rows = [(0, 600), (1, 600), (3, 600), (4, 9000), (7, 600), (8, 600)]
    wide = [(r, 20, p, 40, 0, 9, 10, p / 10, 25) for r, p in rows]
    base = {r for r, _ in rows}
    wide += [(r, 2, 4, 2, 0, 9, 10, 0.4, 0) for r in range(10) if r not in base]
    features = spark.createDataFrame(wide, "r long, runs long, products long, max_run long, min_col long, max_col long, span long, lower_bound double, bin int")
    empty = spark.createDataFrame([], "r long, c long, v double")
    routes = {r["r"]: r["route"] for r in light.choose_routes(Matrix(empty, 10), features=features).routes.collect()}
    assert [r for r, route in sorted(routes.items()) if route == 3] == [0, 1, 4]


def test_tuning_rejects_bad_values():
    for bad in ({"compression": 200}, {"min_products": 1}, {"sample_rate": 1.5}):
        with pytest.raises(ValueError):
            light.LightOptions.tuned(**bad)
    assert light.LightOptions.tuned(compression=4.0).dense_min_compression == 4.0


def test_a_dense_block_routes_dense_in_a_wide_matrix(spark):
    block = spark.range(100 * 100).select((F.col("id") / 100).cast("long").alias("r"), (F.col("id") % 100).alias("c"), F.lit(1.0).alias("v"))
    plan = light.choose_routes(Matrix(block, 70_000))
    row = plan.summary().first()
    assert (row["dense_rows"], row["eligible_rows"], plan.mode()) == (100, 100, "dense")


def test_every_bin_is_sampled_at_its_rate(spark):
    rows = spark.range(30_000).select(F.col("id").alias("r"), F.when(F.col("id") < 20_000, 3).when(F.col("id") < 29_990, 20).otherwise(40).alias("bin"))
    got = {r["bin"]: r["n"] for r in light.sample_rows(rows, 30_000, light.LightOptions()).groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert got == {3: 600, 20: 300, 40: 1}
    first = [r["r"] for r in light.sample_rows(rows.filter("bin = 40"), 30_000, light.LightOptions(sample_rate=0.3)).orderBy("r").collect()]
    assert first == [29_990, 29_993, 29_996]        # s * 10 // 3 for s = 0, 1, 2


def jobs_of(spark, run):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{id(run)}"
    spark.sparkContext.setJobGroup(group, group)
    run()
    spark.sparkContext.setJobGroup("", "")
    return len(tracker.getJobIdsForGroup(group))


def test_few_jobs_build_the_adaptive_product(spark, tables):
    from matrel import multiply

    m = tables.matrix("blend")
    spark.conf.set("spark.sql.adaptive.enabled", "false")       # adaptive execution counts every stage as a job
    try:
        assert jobs_of(spark, lambda: multiply(m, mode="adaptive")) <= 16
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_joins_that_are_to_shuffle_broadcast_nothing(tables):
    from matrel import multiply
    from matrel.operators.joins import Limits

    plan = multiply(tables.matrix("part"), mode="merge", limits=Limits(broadcast_values=0))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in text and "ShuffledHashJoin" in text


@pytest.mark.parametrize("limits", [Limits(), Limits(pairs_per_task=8192), Limits(broadcast_values=0, pairs_per_task=1 << 14)])
def test_adaptive_takes_each_class_apart(hub, tables, limits):
    from matrel import multiply

    for m in (hub, tables.matrix("blend")):
        merge, adaptive = multiply(m, mode="merge"), multiply(m, mode="adaptive", limits=limits)
        assert adaptive.exceptAll(merge).count() == 0 and merge.exceptAll(adaptive).count() == 0


def test_the_earlier_gate_admits_two_regimes(spark):
    from matrel.plans.policy import calibrated_mode

    cases = [("ADAPTIVE", 0.15, 512, 128, 7, "ADAPTIVE"), ("ADAPTIVE", 0.15, 511, 128, 0, "MERGE_ONLY"), ("ADAPTIVE", 0.21, 512, 128, 0, "MERGE_ONLY"),
             ("ADAPTIVE", 0.8, 2048, 1024, 0, "ADAPTIVE"), ("ADAPTIVE", 0.8, 2048, 1024, 1, "MERGE_ONLY"), ("DENSE_ONLY", 0.15, 512, 128, 0, "MERGE_ONLY")]
    rows = spark.createDataFrame(cases, "mode string, work double, merge long, dense long, unclear long, want string")
    got = rows.select("want", calibrated_mode(F.col("mode"), F.col("work"), F.col("merge"), F.col("dense"), F.col("unclear")).alias("got"))
    assert all(r["want"] == r["got"] for r in got.collect())


def test_summaries_hold_the_earlier_gate(hub):
    import __spark_entry__ as entry

    assert light.choose_routes(hub).summary().first()["calibrated_mode"] == "MERGE_ONLY"
    for name in ("plan_summary", "policy_decision"):
        assert "calibrated_mode" in entry.oracle_sql()[name]
