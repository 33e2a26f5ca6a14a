"""Exact sums of single-precision products."""

import math
import random
import struct
from fractions import Fraction
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel.operators import exact, verify
from matrel.operators.coo import Matrix
from matrel.operators.joins import Limits


def cells(seed, n=14, count=90, low=-40, high=40):
    rnd = random.Random(seed)
    out = {}
    for _ in range(count):
        v = float(np.float32(rnd.choice([-1, 1]) * rnd.random() * 2.0 ** rnd.randint(low, high)))
        if v:
            out[rnd.randrange(n), rnd.randrange(n)] = v
    return [(r, c, v) for (r, c), v in out.items()]


def true_sums(rows):
    out = {}
    for r, k, v in rows:
        for k2, c, w in rows:
            if k2 == k:
                out[r, c] = out.get((r, c), Fraction(0)) + Fraction(v) * Fraction(w)
    return out


def bits(rows):
    return {(r["r"], r["c"]): struct.pack(">d", r["v"]) for r in rows}


@pytest.mark.parametrize("low,high", [(-2, 2), (-40, 40), (-126, 120), (-149, -100)])
def test_sums_are_the_nearest_doubles(matrix_of, low, high):
    rows = cells(high, low=low, high=high)
    want = {k: v for k, v in true_sums(rows).items() if v}
    got = {(x["r"], x["c"]): x for x in exact.exact_multiply(matrix_of(rows, 14)).collect()}
    assert set(got) == set(want)
    for k, x in got.items():
        assert Fraction(int(x["numerator"])) * Fraction(2) ** x["exponent"] == want[k]
        assert x["v"] == float(want[k])                     # correctly rounded by the rationals


def test_cancellation_is_exact(matrix_of):
    big, small = float(2.0 ** 60), float(np.float32(1e-20))
    rows = [(0, 1, big), (0, 2, small), (0, 3, -big), (1, 5, 1.0), (2, 5, 1.0), (3, 5, 1.0), (4, 1, 1.0), (4, 3, -1.0)]
    got = {(x["r"], x["c"]): x["v"] for x in exact.exact_multiply(matrix_of(rows, 6)).collect()}
    assert got == {(0, 5): small}
    kept = {(x["r"], x["c"]): (x["v"], x["numerator"]) for x in exact.exact_multiply(matrix_of(rows, 6), keep_structural=True).collect()}
    assert kept[(4, 5)] == (0.0, "0")


def test_every_plan_gives_the_same_bits(spark, matrix_of):
    rows = cells(5, n=20, count=900, low=-12, high=12)
    m = matrix_of(rows, 20)
    want = bits(exact.exact_multiply(m).collect())
    shuffled = list(rows)
    random.Random(1).shuffle(shuffled)
    for other, options in ((m, dict(ways=4)), (m, dict(limits=Limits(broadcast_values=0))), (m, dict(limits=Limits(broadcast_values=0, pairs_per_cell=9))),
                           (Matrix(matrix_of(shuffled, 20).entries.repartition(7), 20), dict(ways=3, limits=Limits(broadcast_values=0, rows_per_task=5)))):
        assert bits(exact.exact_multiply(other, **options).collect()) == want
    # a plain sum of doubles in another order does differ somewhere
    table = {}
    for r, k, v in rows:
        for k2, c, w in reversed(rows):
            if k2 == k:
                table.setdefault((r, c), []).append(v * w)
    assert any(reduce(add, t) != reduce(add, reversed(t)) for t in table.values())


def test_values_that_are_not_finite(matrix_of):
    rows = [(0, 1, math.inf), (1, 2, 2.0), (0, 3, 1.0), (3, 2, math.nan), (4, 1, -math.inf), (5, 1, math.inf), (5, 6, 1.0), (6, 2, -math.inf)]
    got = {(x["r"], x["c"]): (x["v"], x["numerator"]) for x in exact.exact_multiply(matrix_of(rows, 7)).collect()}
    assert math.isnan(got[(0, 2)][0]) and got[(4, 2)] == (-math.inf, None) and math.isnan(got[(5, 2)][0])
    assert exact.exact_multiply(matrix_of([(0, 1, 1.0)], 3)).collect() == []


def test_single_precision_exercises_the_bound(spark, tables):
    m = tables.matrix("cust")
    m = Matrix(m.entries.withColumn("v", F.col("v") / 7 + F.col("c") / 1000), m.n)
    rounded = Matrix(exact.single(m.entries), m.n)
    report = verify.report(verify.verify(rounded, exact.single_multiply(m)), m.n).first()
    assert report["mismatches"] == 0 and report["max_deviation"] > 0 and report["cells"] > 100
    wrong = exact.single_multiply(m).withColumn("v", F.col("v") * 1.01)
    assert verify.report(verify.verify(rounded, wrong), m.n).first()["mismatches"] > 0


def test_products_are_exchanged_before_their_limbs(matrix_of):
    from matrel.operators.joins import Limits

    m = matrix_of([(r, (r * 7 + k) % 30, r + k + 0.5) for r in range(30) for k in range(4)], 30)
    found = exact.exact_multiply(m, limits=Limits(broadcast_values=0))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert text.count("REPARTITION_BY_NUM") == 3 and text.count("Exchange") == 3
    assert {tuple(x) for x in found.collect()} == {tuple(x) for x in exact.exact_multiply(m).collect()}
