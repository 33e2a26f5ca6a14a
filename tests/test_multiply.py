"""The product in all forms and join shapes, against brute force."""

import math
import random

import pytest
from conftest import brute_product, cells_of
from pyspark.sql import functions as F

from matrel.operators import multiply as mul
from matrel.operators.joins import Limits, cuts_of, join_shape
from matrel.operators.tiles import Workspaces

SHUFFLED = Limits(broadcast_values=0, pairs_per_cell=10**9)
CUT = Limits(broadcast_values=0, pairs_per_cell=16)
CUT_BROADCAST_KEYS = Limits(broadcast_values=9, pairs_per_cell=16)


def random_cells(seed, n, count, hot=None):
    """Unique cells; with ``hot`` a third of them share that row and column."""
    rng = random.Random(seed)
    cells = {}
    while len(cells) < count:
        r, c = rng.randrange(n), rng.randrange(n)
        if hot is not None and rng.random() < 0.34:
            if rng.random() < 0.5:
                r = hot
            else:
                c = hot
        cells[(r, c)] = rng.choice([-2, -1, 1, 2, 3])
    return [(r, c, v) for (r, c), v in cells.items()]


@pytest.mark.parametrize("limits", [Limits(), SHUFFLED, CUT, CUT_BROADCAST_KEYS])
@pytest.mark.parametrize("structural", [False, True])
def test_forms_equal_brute_force(matrix_of, limits, structural):
    cells = random_cells(1, 90, 500, hot=7)
    m = matrix_of(cells, 90)
    want = brute_product(cells, cells, structural)
    assert cells_of(mul.multiply(m, mode="merge", keep_structural=structural, limits=limits)) == want
    assert cells_of(mul.multiply(m, mode="dense", keep_structural=structural, limits=limits)) == want
    assert cells_of(mul.heavy_multiply(m.entries, m.entries, structural, limits)) == want


def test_adaptive_unites_both_forms(matrix_of, spark):
    cells = random_cells(2, 60, 400)
    m = matrix_of(cells, 60)
    routes = spark.range(60).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, 3).otherwise(2).alias("route"))
    for limits in (Limits(), CUT):
        assert cells_of(mul.multiply(m, mode="adaptive", routes=routes, limits=limits)) == brute_product(cells, cells)


def test_rectangular_ranges(matrix_of):
    cells = random_cells(3, 50, 300)
    want = {k: v for k, v in brute_product(cells, cells).items() if 10 <= k[0] < 30 and 5 <= k[1] < 20}
    for mode in ("merge", "dense"):
        assert cells_of(mul.multiply(matrix_of(cells, 50), mode=mode, rows=(10, 30), columns=(5, 20))) == want


def test_ranges_reach_the_scan(tables):
    m = tables.matrix("cust")
    plan = mul.multiply(m, mode="merge", rows=(3, 9), columns=(5, 20))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(r,3)" in plan and "LessThan(c,20)" in plan


def test_wide_tiles_cross_boundaries(matrix_of):
    rng = random.Random(4)
    n = 5000
    cells = {(rng.randrange(n), rng.choice([0, 511, 512, 1023, 1024, 4999])): 1.0 for _ in range(200)}
    cells.update({(k, rng.randrange(n)): 2.0 for k in (0, 511, 512, 1023, 1024, 4999) for _ in range(40)})
    cells = [(r, c, v) for (r, c), v in cells.items()]
    assert cells_of(mul.multiply(matrix_of(cells, n), mode="dense")) == brute_product(cells, cells)


def test_matrix_product_path_and_structure():
    import numpy as np

    size = 64 * 1024
    rng = np.random.default_rng(5)
    ax, ak = np.divmod(np.arange(64 * 512), 512)
    bk, bc = np.divmod(np.arange(512 * 1024), 1024)
    av, bv = rng.integers(-1, 2, len(ax)).astype(float), rng.integers(-1, 2, len(bk)).astype(float)
    full = Workspaces(structural=True)
    full.add((0, 0), (ax, ak, av), (bk, bc, bv))
    want = av.reshape(64, 512) @ bv.reshape(512, 1024)
    assert (full.values[(0, 0)].reshape(64, 1024) == want).all()
    assert full.touched[(0, 0)].sum() == size                # zero-valued entries still count


def test_non_finite_values_stay_local(matrix_of):
    cells = [(0, 0, math.inf), (0, 1, 1.0), (1, 1, math.nan), (1, 0, 2.0), (2, 2, 1.0)]
    for mode in ("merge", "dense"):
        got = cells_of(mul.multiply(matrix_of(cells, 3), mode=mode))
        assert got[(2, 2)] == 1.0 and got[(0, 0)] == math.inf and math.isnan(got[(1, 1)])


def test_cells_cover_every_pair_once(spark):
    left = spark.range(1000).select(F.lit(5).cast("long").alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.lit(5).cast("long").alias("k2"), F.col("id").alias("b"))
    limits = Limits(broadcast_values=0, pairs_per_cell=400)
    shape = join_shape(left, "k", right, "k2", limits)
    cut = cuts_of(shape, limits).first()
    assert (shape.pairs, shape.hot_keys, cut["cut_l"], cut["cut_r"]) == (300_000, 1, 50, 15)
    from matrel.operators.joins import spread_join

    pairs = spread_join(left, "k", ["a"], right, "k2", ["b"], shape, limits)
    assert pairs.count() == 300_000 == pairs.select("a", "b").distinct().count()


def test_direct_rows_are_scaled_copies(matrix_of):
    cells = [(0, 2, 3.0), (1, 0, 1.0), (1, 2, 1.0), (2, 0, 2.0), (2, 1, 4.0), (3, 4, 1.0)]
    got = cells_of(mul.direct_multiply(matrix_of(cells, 5).entries, matrix_of(cells, 5).entries))
    assert got == {(0, 0): 6.0, (0, 1): 12.0}               # row 3 refers to an empty row


def test_modes_are_checked():
    assert mul.resolve_mode("DENSE_ONLY") == "dense"
    with pytest.raises(ValueError):
        mul.resolve_mode("fastest")


def test_kernel_scenarios(matrix_of):
    """Tasks (scale, sorted items) per logical row: A holds the scales, B the items."""
    tasks = [
        (0, 2.0, {1001: 1, 1003: 2}), (0, 1.0, {1001: 3, 1002: 4}),
        (1, 1.0, {c: 1 for c in range(2001, 2009)}), (1, 1.0, {c: 2 for c in range(2004, 2012)}),
        (2, 1.0, {3005: 1, 3009: 2, 3013: 3}), (2, 1.0, {3005: 4, 3009: -2, 3014: 6}),
        (3, 1.0, {4005: 1, 36773: 2, 36774: 3}), (3, 1.0, {4005: 4, 36773: -2, 36775: 6}),
        (0, 1.0, {70001: 7}),
        *[(6, 1.0, {80000 + i: 1}) for i in range(64)],
        *[(6, 1.0, {80064 + s: 1}) for s in (0, 2, 3, 4, 5, 6, 7)],
        *[(7 + i, 1.0, {100000 + 64 * i + s: 1}) for i in range(256) for s in range(8)],
    ]
    a = matrix_of([(row, k, scale) for k, (row, scale, _) in enumerate(tasks)], 10**6)
    b = matrix_of([(k, c, v) for k, (_, _, items) in enumerate(tasks) for c, v in items.items()], 10**6)
    expected = {(0, 1001): 5, (0, 1002): 4, (0, 1003): 4, (0, 70001): 7,
                (2, 3005): 5, (2, 3013): 3, (2, 3014): 6, (3, 4005): 5, (3, 36774): 3, (3, 36775): 6}
    for mode in ("merge", "dense"):
        got = cells_of(mul.multiply(a, b, mode=mode))
        by_row = {}
        for (r, c), v in got.items():
            by_row.setdefault(r, {})[c] = v
        assert {k: v for k, v in got.items() if k[0] in (0, 2, 3)} == expected
        assert by_row[1] == {**{c: 1 for c in range(2001, 2004)}, **{c: 3 for c in range(2004, 2009)},
                             **{c: 2 for c in range(2009, 2012)}}
        assert 4 not in by_row and len(by_row[6]) == 71
        assert all(len(by_row[7 + i]) == 8 for i in range(256))


def test_single_item_rows(matrix_of):
    cells = [(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0)]
    for mode in ("merge", "dense"):
        assert len(cells_of(mul.multiply(matrix_of(cells, 3), mode=mode))) == 3


def test_empty_operands(matrix_of):
    for mode in ("merge", "dense"):
        assert mul.multiply(matrix_of([], 4), mode=mode).count() == 0


def test_joins_are_sized_by_rows_as_well_as_pairs(spark):
    """A large B that few keys of A meet: many rows, few pairs, and one key that no task could hold as a table."""
    left = spark.createDataFrame([(0, 5, 1.0)], "r long, c long, v double")
    right = spark.range(4000).select((F.col("id") % 40).alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    limits = Limits(broadcast_values=0, rows_per_task=100)
    shape = join_shape(left, "c", right, "r", limits)
    assert shape.pairs == 100 and shape.widest == 100 and shape.partitions(limits) == 40 and shape.hint(limits) == "shuffle_hash"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(mul.partial_products(left, right, limits))
    assert "ShuffledHashJoin" in text and text.count("hashpartitioning") == 2 and ", 40), REPARTITION_BY_NUM" in text
    tight = Limits(broadcast_values=0, rows_per_task=99)
    assert "SortMergeJoin" in plan(mul.partial_products(left, right, tight))
    for build in (lambda: mul.heavy_multiply(left, right, limits=limits), lambda: mul.reference_product(mul.Matrix(left, 4000), mul.Matrix(right, 4000), limits)):
        assert ", 40), REPARTITION_BY_NUM" in plan(build()).split("Join")[0]
        assert build().count() == 100


def test_form_by_cost(matrix_of, tables):
    from matrel.plans.light import choose_form

    assert choose_form(tables.matrix("supp"))[0] in ("dense", "merge")
    dense = [(r, c, 1) for r in range(40) for c in range(40)]
    sparse = [(r, (r * 7) % 40 + 40, 1) for r in range(40, 80)]
    assert choose_form(matrix_of(dense, 40))[0] == "dense"
    form, routes = choose_form(matrix_of(dense + sparse, 80))
    assert form == "adaptive" and {x["route"] for x in routes.collect()} == {1, 3}
    assert choose_form(matrix_of(sparse, 80))[0] == "merge"
    mixed = matrix_of(dense + sparse, 80)
    assert cells_of(mul.multiply(mixed)) == brute_product(dense + sparse, dense + sparse)


def test_hash_tables_are_bounded_by_their_values(matrix_of, monkeypatch):
    """Few left rows against many wide right ones: the hash table of a task follows rows times columns."""
    from matrel.operators import joins

    monkeypatch.setattr(joins, "VALUES_PER_TASK", 100)
    right = matrix_of([(i, i % 7, 1) for i in range(1000)], 1000).entries.select(F.col("r").alias("kb"), "c", "v")
    left = matrix_of([(0, i, 1) for i in range(0, 1000, 100)], 1000).entries.select("r", F.col("c").alias("k"))
    got = joins.spread_join(left, "k", ["r"], right, "kb", ["c"], limits=Limits(broadcast_values=0))
    assert got.rdd.getNumPartitions() == 30 and got.count() == 10
