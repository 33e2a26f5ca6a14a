"""Products of the grid: no exchange of products, bounded tasks, odd keys."""

import random

import numpy as np
import pytest
from conftest import brute_product, cells_of

from pyspark.sql import functions as F

from matrel.operators import grid
from matrel.operators import multiply as mul
from matrel.operators.coo import Matrix
from matrel.operators.joins import Limits, join_shape

MANY = Limits(broadcast_values=0, pairs_per_task=64)


def some_cells(seed, n, count):
    rnd = random.Random(seed)
    cells = {(rnd.randrange(n), rnd.randrange(n)): rnd.choice([-2, -1, 1, 2, 3]) for _ in range(count)}
    cells.update({(5, c): 1 for c in range(n)})
    cells.update({(r, 7): 1 for r in range(n)})
    return [(r, c, v) for (r, c), v in cells.items()]


@pytest.mark.parametrize("structural", [False, True])
def test_all_forms_by_the_grid(matrix_of, structural):
    cells = some_cells(1, 90, 500)
    m = matrix_of(cells, 90)
    shape = join_shape(m.entries, "c", m.entries, "r", MANY)
    assert grid.repays(shape, MANY) and grid.grid_of(shape, MANY).rows > 1 < grid.grid_of(shape, MANY).columns
    want = brute_product(cells, cells, structural)
    for got in (mul.merge_multiply(m.entries, m.entries, structural, MANY), mul.dense_multiply(m.entries, m.entries, structural, MANY),
                mul.heavy_multiply(m.entries, m.entries, structural, MANY)):
        assert cells_of(got) == want and got.count() == len(want)


def test_products_are_not_exchanged(matrix_of):
    m = matrix_of(some_cells(2, 60, 300), 60)
    for form in (mul.merge_multiply, mul.dense_multiply, mul.heavy_multiply):
        plan = form(m.entries, m.entries, limits=MANY)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Join" not in plan


def test_sparse_rows_take_no_tiles(matrix_of):
    """Every entry alone in its tile: pairs of tiles would outnumber the products."""
    n = 100_000
    rnd = random.Random(3)
    cells = [(r, c, 1) for r, c in {(rnd.randrange(n), rnd.randrange(n)) for _ in range(400)}] + [(c, rnd.randrange(n), 2) for c in range(0, n, 500)]
    cells = list({(r, c): (r, c, v) for r, c, v in cells}.values())
    m = matrix_of(cells, n)
    got = mul.dense_multiply(m.entries, m.entries)
    assert "items_kb" not in got._jdf.queryExecution().executedPlan().toString()
    assert cells_of(got) == brute_product(cells, cells)


def test_null_and_far_indices(spark):
    rows = [(None, 1, 2.0), (0, None, 3.0), (0, 1, 1.0), (1, None, 5.0), (1, 1 << 40, 7.0), (1 << 40, 0, 1.0), (1, 0, 4.0)]
    a = spark.createDataFrame(rows, "r long, c long, v double")
    shape = join_shape(a, "c", a, "r")
    got = sorted(mul.gridded(a, a, False, Limits(), shape).collect(), key=str)
    want = sorted(mul.summed(mul.partial_products(a, a), False).collect(), key=str)
    assert got == want and any(x["r"] is None for x in got) and any(x["c"] is None for x in got)


@pytest.mark.parametrize("direct", [False, True])
def test_rows_and_lists_longer_than_a_step(monkeypatch, direct):
    monkeypatch.setattr(grid, "EXPANSION", 7)
    monkeypatch.setattr(grid, "BUFFER", 5)
    rnd = np.random.default_rng(4)
    right = {(int(k), int(c)): float(v) for k, c, v in zip(rnd.integers(0, 12, 80), rnd.integers(0, 30, 80), rnd.integers(-3, 4, 80))}
    right.update({(3, c): 1.0 for c in range(30)})
    left = {(int(r), int(k)): 1.0 for r, k in zip(rnd.integers(0, 6, 40), rnd.integers(0, 14, 40))}
    block = grid.Block(1, False, direct)
    b = np.array([(k, c, v) for (k, c), v in sorted(right.items())])
    block.add_right(b[:, 0].astype(int), b[:, 1].astype(int), b[:, 2])
    found = {}
    batches = []
    for (r, k), v in sorted(left.items()):
        batches += block.add_left(np.array([r]), np.array([k]), np.array([v]))
    for batch in [*batches, *block.finish()]:
        for r, c, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
            assert (r, c) not in found
            found[(r, c)] = v
    assert found == brute_product([(r, k, v) for (r, k), v in left.items()], [(k, c, v) for (k, c), v in right.items()])


def test_window_work_by_the_grid(matrix_of):
    from matrel.operators.windows import window_work

    cells = some_cells(6, 80, 500)
    m = matrix_of(cells, 80)
    want = {tuple(x) for x in window_work(m, width=16).collect()}
    got = window_work(m, width=16, limits=MANY)
    assert got.schema == window_work(m, width=16).schema and {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_window_totals_are_added_up_where_the_work_is_made(matrix_of):
    from matrel.operators.windows import window_summary, window_totals, window_work

    for n, cells in ((80, some_cells(6, 80, 500)), (300, some_cells(7, 300, 6000))):
        m = matrix_of(cells, n)
        holed = Matrix(m.entries.withColumn("c", F.when(F.col("v") > 2, F.col("c"))).unionAll(m.entries.limit(20)), n)
        for x in (m, holed):
            want = window_summary(window_work(x, width=16))
            got = window_totals(x, width=16, limits=MANY)
            assert got.schema == want.schema and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_tasks_stay_bounded_as_tables_grow(spark):
    from matrel.operators.joins import JoinShape

    for size in (10**6, 10**8, 10**9):
        shape = JoinShape(size, size, 30.0 * size, 0, spark.range(1))
        cut = grid.grid_of(shape, Limits())
        assert size / cut.columns <= grid.RIGHT_ENTRIES and size / cut.rows <= grid.LEFT_ENTRIES


def test_stacked_matrices_are_not_staged_again(tables):
    blend, supp, cust = (tables.matrix(x) for x in ("blend", "supp", "cust"))
    assert set(blend.entries.inputFiles()) == set(supp.entries.inputFiles()) | set(cust.entries.inputFiles())
    assert blend.n == supp.n + cust.n and blend.entries.count() == supp.entries.count() + cust.entries.count()


def test_one_exchange_builds_a_matrix(tables):
    plan = tables._part()[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning" in plan


@pytest.mark.parametrize("whole", [True, False])
def test_blocks_of_a_class_hold_every_entry_once(monkeypatch, whole):
    import pyarrow as pa

    monkeypatch.setattr(grid, "BLOCK", 10)
    rnd = np.random.default_rng(5)
    keys = np.sort(rnd.choice([-3, 0, 1, 2, 5, 1 << 40, grid._NULL], 90, p=[.1, .1, .4, .1, .1, .1, .1]))
    xs, vs = rnd.integers(0, 50, 90) + (keys == 5) * (1 << 35), rnd.choice([0.1, 2.0, np.nan, -0.0], 90)
    batches = []
    for begin in range(0, 90, 30):
        some = slice(begin, begin + 30)
        starts = np.flatnonzero(np.diff(keys[some], prepend=1 << 60))
        ends = pa.array(np.append(starts, 30).astype(np.int32))
        batches.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), 4, np.int32)), pa.array(keys[some][starts]), pa.ListArray.from_arrays(ends, pa.array(xs[some])),
                                                   pa.ListArray.from_arrays(ends, pa.array(vs[some]))], names=["own", "s", "x", "v"]))
    out = [x.to_pylist()[0] for x in grid._blocks(1, whole)(iter(batches))]
    assert [x["block"] for x in out] == list(range(len(out))) and [x["last"] for x in out] == [False] * (len(out) - 1) + [True]
    parts = [grid._from_bytes(x["data"], 1) for x in out]
    for i, want in enumerate((keys, xs, vs)):
        assert np.concatenate([p[i] for p in parts]).tobytes() == want.tobytes()
    held = [set(p[0].tolist()) for p in parts]
    assert len(out) > 3 and (sum(map(len, held)) == len(set(keys.tolist()))) == whole


def test_entries_are_staged_once_however_many_tasks(matrix_of, monkeypatch):
    cells = some_cells(8, 120, 900)
    m = matrix_of(cells, 120)
    staged, plain = [], grid.stage

    def counted(df):
        df = plain(df)
        staged.append(sum(len(grid._from_bytes(x["data"], 1)[0]) for x in df.collect()))
        return df

    monkeypatch.setattr(grid, "stage", counted)
    for limits in (MANY, Limits(broadcast_values=0, pairs_per_task=4)):
        shape = join_shape(m.entries, "c", m.entries, "r", limits)
        assert grid.grid_of(shape, limits).copies(shape) >= 4 * len(cells)
        assert cells_of(mul.gridded(m.entries, m.entries, False, limits, shape)) == brute_product(cells, cells)
    assert staged == [len(cells)] * 4


def test_memory_of_a_task_at_1_gb(spark):
    """36 million entries and 30 products of each: what a task holds of B, and what it makes of some of A."""
    import tracemalloc

    from matrel.operators.joins import JoinShape

    shape = JoinShape(36 * 10**6, 36 * 10**6, 1.08e9, 0, spark.range(1))
    held = 36 * 10**6 // grid.grid_of(shape, Limits()).columns
    rnd = np.random.default_rng(9)
    block = grid.Block(2, True, True)
    tracemalloc.start()
    for begin in range(0, held, 1 << 15):
        many = min(1 << 15, held - begin)
        block.add_right(rnd.integers(0, 1 << 20, many, np.int32), rnd.integers(0, 280, many, np.int32), np.ones((many, 2), np.float32))
    cells = sum(b.num_rows for b in [*block.add_left(np.arange(1 << 17) // 30, rnd.integers(0, 1 << 20, 1 << 17), np.ones(1 << 17)), *block.finish()])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert cells > 10_000 and most < 150e6


def test_large_values_are_staged_in_small_row_groups(spark):
    import pyarrow.dataset as ds

    from matrel.session import stage_values

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda i: F.sha2((F.col("id") * 10_000 + i).cast("string"), 512)), "")
    staged = stage_values(spark.range(200).coalesce(1).select("id", text.cast("binary").alias("data")))
    groups = [g.total_byte_size for f in ds.dataset(staged.staged_at, format="parquet").get_fragments() for g in f.row_groups]
    assert sum(groups) > 45 << 20 and max(groups) < 20 << 20


def test_batches_of_blocks_stay_small():
    assert 10_000 * (32 + 24 * grid.BLOCK) <= 64 << 20


def test_entries_of_b_in_any_order(monkeypatch):
    """Keys and columns that fall behind, lie far apart or are null; values that 4 bytes do not hold."""
    import pyarrow as pa

    monkeypatch.setattr(grid, "PART", 7)
    rnd = np.random.default_rng(10)
    for far in (1, 1 << 40):
        cells = {(int(k) * far, int(c) * far): float(v) for k, c, v in zip(rnd.integers(0, 12, 90), rnd.integers(-1, 30, 90), rnd.choice([0.1, 2.0, -3.0], 90))}
        cells = {(k, grid._NULL if c < 0 else c): v for (k, c), v in cells.items()}
        rows = [(k, c, v) for (k, c), v in cells.items()]
        batches = [pa.RecordBatch.from_arrays([pa.array([c % 3 for _, c, _ in some], pa.int64()), *map(pa.array, zip(*some))], names=["own", "s", "x", "v"])
                   for some in (rows[:40], rows[40:])]
        dealt = [x for batch in grid._dealt(1, 3)(iter(batches)) for x in batch.to_pylist()]
        got = {}
        for x in dealt:
            key, column, v = grid._from_bytes(x["data"], 1)
            assert len(key) <= 7 and set((column % 3).tolist()) == {x["own"]}
            got.update({(int(k), int(c)): y for k, c, y in zip(key, column, v)})
        assert got == cells
        left = [(r, k * far, 1.0) for r in range(5) for k in range(0, 12, 2)]
        datas = [x["data"] for x in dealt]
        first = grid._to_bytes(*(np.array(y) for y in zip(*left[:6])))
        later = grid._to_bytes(*(np.array(y) for y in zip(*left[6:])))
        met = pa.RecordBatch.from_arrays([pa.array([*datas, None], pa.binary()), pa.array([first, *[None] * (len(datas) - 1), later], pa.binary())], names=["right", "left"])
        found = {}
        for batch in grid._summed(1, False, True)(iter([met.slice(0, 3), met.slice(3)])):
            for r, c, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found[(r, grid._NULL if c is None else c)] = v
        want = brute_product(left, [(k, c, v) for (k, c), v in cells.items()])
        assert found.keys() == want.keys() and all(abs(found[x] - want[x]) < 1e-9 for x in want)


def test_shares_of_a_are_even(spark, tmp_path):
    """Three shares of four partitions would be one of two and two of one."""
    spark.range(0, 4000, 1, 16).write.parquet(f"{tmp_path}/many")
    read = spark.read.parquet(f"{tmp_path}/many")
    files = read.rdd.getNumPartitions()
    assert files > 1 and grid._shares(read, files - 1).rdd.getNumPartitions() == files
    assert grid._shares(spark.range(0, 4000, 1, 16), 3).rdd.getNumPartitions() == 3


def test_a_is_sorted_by_all_cores(matrix_of, monkeypatch):
    m = matrix_of(some_cells(11, 60, 300), 60)
    seen, plain = [], grid._staged_left
    monkeypatch.setattr(grid, "_staged_left", lambda entries, classes: seen.append(classes) or plain(entries, classes))
    monkeypatch.setattr(grid, "SORTED_ENTRIES", 20)
    cells = [tuple(x) for x in m.entries.collect()]
    shape = join_shape(m.entries, "c", m.entries, "r", Limits(broadcast_values=0))
    assert cells_of(mul.gridded(m.entries, m.entries, False, Limits(broadcast_values=0), shape)) == brute_product(cells, cells)
    assert seen == [-(-len(cells) // 20)]


def test_null_windows_have_a_bound_too():
    import pyarrow as pa

    from matrel.operators.windows import _window_totals

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([None, None, 18]), pa.array([2.0, 3.0, 1.0]), pa.array([40.0, 5.0, 90.0])], names=["r", "c", "v0", "v1"])
    out = [x for b in _window_totals(300, 16)(iter([batch])) for x in b.to_pylist()]
    assert {x["w"]: x["output_upper"] for x in out} == {None: 21, 18: 12}
