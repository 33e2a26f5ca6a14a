"""Running values, batches and islands against sequential code."""

import random

import pytest
from pyspark.sql import functions as F

from matrel.operators.batches import merge_islands, row_batches
from matrel.operators.ordered import rank_within, running


@pytest.mark.parametrize("block", [3, 16, 1 << 16])
def test_running_sums_and_maxima(spark, block):
    rng = random.Random(1)
    values = [(i, rng.randrange(5), None if rng.random() < 0.7 else i) for i in range(100) if i % 7]
    df = spark.createDataFrame(values, "i long, v long, m long")
    got = {r["i"]: (r["s"], r["x"]) for r in running(df, "i", 100, {"s": "v"}, {"x": "m"}, block=block).collect()}
    total, best = 0, None
    for i, v, m in values:
        assert got[i] == (total, best)
        total += v
        best = m if m is not None else best


def test_rank_inside_a_hot_group(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("g"), (F.col("id") * 2).alias("o"))
    rows = rank_within(df, "o", 1000, ("g",), block=10).collect()
    hot = sorted((r["o"], r["pos"]) for r in rows if r["g"] == -1)
    assert [p for _, p in hot] == list(range(len(hot)))
    assert all(r["pos"] == 0 for r in rows if r["g"] != -1)


def greedy(weights, budgets, even):
    n, out, begin, sums = len(weights), [], 0, [0] * len(budgets)
    r = 0
    while r < n:
        if r != begin and any(s + w > b for s, w, b in zip(sums, weights[r], budgets)):
            end = r + (r & 1) if even else r
            out.append((begin, min(end, n)))
            begin, sums = end, [0] * len(budgets)
            r = begin
            continue
        sums = [s + w for s, w in zip(sums, weights[r])]
        r += 1
    if begin < n:
        out.append((begin, n))
    return out


@pytest.mark.parametrize("seed,even", [(1, False), (2, True), (3, False), (4, True)])
def test_batches_equal_the_sequential_rule(spark, seed, even):
    rng = random.Random(seed)
    weights = [(rng.choice([0, 0, 1, 5, 40]), rng.randrange(4)) for _ in range(120)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(weights)], "r long, a long, b long")
    got = row_batches(df, 120, {"a": 30, "b": 9}, even).orderBy("batch").collect()
    want = greedy(weights, (30, 9), even)
    assert [(x["begin_row"], x["end_row"]) for x in got] == want
    assert [x["a"] for x in got] == [sum(w[0] for w in weights[b:e]) for b, e in want]


def test_one_batch_when_budgets_suffice(spark):
    df = spark.range(5).select(F.col("id").alias("r"), F.lit(1).cast("long").alias("a"))
    assert [tuple(x) for x in row_batches(df, 5, {"a": 5}).collect()] == [(0, 0, 5, 5)]


def test_islands_equal_the_sequential_rule(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([2] * 120 + [1, 3]), rng.choice([1] + [9] * 200 + [200]), rng.choice([0] + [60] * 150)) for i in range(600)]
    df = spark.createDataFrame(rows, "r long, route int, tasks long, products long")
    got = sorted(tuple(x) for x in merge_islands(df, 600).collect())
    ok = [r[1] == 2 and 2 <= r[2] <= 180 and r[3] > 0 for r in rows]
    want, i = [], 0
    while i < 600:
        if not ok[i]:
            i += 1
            continue
        j = i
        while j < 600 and ok[j] and j - i < 64:
            j += 1
        products = sum(r[3] for r in rows[i:j])
        want.append((i, j - i, products, j - i >= 4 and products >= 512))
        i = j
    assert got == want and max(w[1] for w in want) == 64
