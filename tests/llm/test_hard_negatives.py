import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel.llm import hard_negatives as hn
from tests.llm.helpers import SMALL


def brute(rows, every=2, positives=5, negatives=3, low=50, high=95):
    """Rows of (vec_id, label, vector), each different one once."""
    sound = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            row = (i, label, tuple(math.floor(256 * x) for x in v))
            if row not in sound and sum(x * x for x in row[2]) < 2 ** 62:
                sound.append(row)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for k, (i, label, v) in enumerate(sound):
        if i % every:
            continue
        ranked = sorted((-dot(v, w), j, n, other) for n, (j, other, w) in enumerate(sound) if n != k)
        for score, j, _, _ in [x for x in ranked if x[3] == label][:positives]:
            hard = [x for x in ranked if x[3] != label and low * -score <= 100 * -x[0] <= high * -score][:negatives]
            out += [(i, j, n, x[1], -score, -x[0]) for n, x in enumerate(hard, 1)]
    return sorted(out)


def mined(spark, rows, every=2, **options):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, label int, embedding array<float>, row string")
    return sorted(map(tuple, hn.hard_negatives(df, F.col("vec_id") % every == 0, **options).collect()))


def vectors(n, width, labels, seed, scale=1.0):
    rnd = np.random.default_rng(seed)
    v = rnd.normal(size=(n, width)).astype(np.float32) * np.float32(scale)
    v[n // 3:n // 2] = v[0]                                  # a third-sized group of copies
    return [(i, int(rnd.integers(labels)), [float(x) for x in v[i]]) for i in range(n)]


@pytest.mark.parametrize("n,width,labels,values", [(60, 3, 2, 1 << 20), (90, 8, 3, 160), (70, 20, 40, 300)])
def test_against_brute_force_over_one_and_many_blocks(spark, n, width, labels, values):
    rows = vectors(n, width, labels, n)
    assert mined(spark, rows, every=5, block_values=values) == brute(rows, every=5)


def test_awkward_rows(spark):
    rows = vectors(40, 4, 2, 1) + [
        (50, None, [1.0] * 4), (52, 1, None), (54, 1, [1.0, None, 0.0, 0.0]), (56, 1, [float("nan")] * 4), (58, 1, [float("inf"), 0.0, 0.0, 0.0]),
        (None, 1, [1.0] * 4), (60, 1, []), (62, 1, [1.0, 2.0]), (64, 0, [1e30, 0.0, 0.0, 0.0]), (66, 0, [1e6, -1e6, 3e5, 7.0])]
    rows += rows[:3] + [(2, 0, [0.5] * 4), (2, 1, [0.25] * 4)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0])]) == []


def test_scores_beyond_the_exact_range_of_doubles(spark):
    rows = [(i, i % 2, [float(1 << 20) + i, float(1 << 19) - 3 * i, 2.0 * i]) for i in range(30)]
    rows = [(i, label, [x * 4.0 for x in v]) for i, label, v in rows]
    assert mined(spark, rows, low=10, high=100) == brute(rows, low=10, high=100)


def test_query_against_sql(spark):
    import duckdb

    path = f"{SMALL}/embeddings.parquet"
    want = sorted(duckdb.sql(hn.SQL.replace("FROM embeddings", f"FROM '{path}'")).fetchall())
    assert sorted(map(tuple, hn.mine(spark.read.parquet(path)).collect())) == want and want


def test_kernel_finds_exactly_the_pairs_at_their_thresholds():
    rnd = random.Random(3)
    for trial in range(30):
        width = rnd.choice([1, 5, 16, 33])
        gen = np.random.default_rng(trial)
        a = gen.integers(-50, 50, (rnd.randint(1, 30), width)) * (gen.random(width) < 0.7)
        r = gen.integers(-50, 50, (rnd.randint(1, 90), width))
        scores = a @ r.T
        t = np.array([rnd.choice([hn.LOWEST, 0, int(s.max()), int(np.quantile(s, 0.9))]) for s in scores])
        got = {(int(i), int(j), int(s)) for x in hn.threshold_pairs(a, t, r) for i, j, s in zip(*x)}
        assert got == {(i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= t[:, None]))}
