"""Runs in tiles: plan, commits, continuation after a loss, stored digests."""

import random

import pytest
from conftest import brute_product, cells_of
from pyspark.sql import functions as F

from matrel import execution
from matrel.execution import ProductRun, tiled_multiply


@pytest.fixture
def small(matrix_of):
    rnd = random.Random(7)
    cells = {(rnd.randrange(30), rnd.randrange(30)): rnd.randrange(1, 9) for _ in range(150)}
    cells.update({(4, c): 1 for c in range(30)})           # one row with far more work than a tile
    cells = [(r, c, v) for (r, c), v in cells.items() if r != 9]
    return matrix_of(cells, 30), brute_product(cells, cells)


def test_tiles_follow_the_running_work(small):
    m, _ = small
    run = ProductRun(m, products=300)
    tiles = run.tiles
    assert tiles[0].begin == 0 and tiles[-1].end == 30 and len(tiles) > 2
    assert all(x.end == y.begin for x, y in zip(tiles, tiles[1:]))
    assert all(t.products - t.longest < 300 for t in tiles)
    products = {r: 0 for r in range(30)}
    rows = [tuple(x) for x in m.entries.collect()]
    degree = {k: sum(1 for r, _, _ in rows if r == k) for k in range(30)}
    for r, c, _ in rows:
        products[r] += degree[c]
    before, owner = 0, {}
    for r in range(30):
        owner[r] = before // 300
        before += products[r]
    assert [t.begin for t in tiles] == [min(r for r in owner if owner[r] == k) for k in sorted(set(owner.values()))]
    assert [t.products for t in tiles] == [sum(products[r] for r in range(t.begin, t.end)) for t in tiles]


@pytest.mark.parametrize("options", [
    dict(products=300), dict(rows=11, columns=16), dict(products=10**6, columns=13, mode="dense"), dict(products=500, mode="adaptive")])
def test_result_is_the_product(small, options):
    m, want = small
    assert cells_of(tiled_multiply(m, **options)) == want


def test_a_run_killed_between_tiles_recomputes_none(small, tmp_path, monkeypatch):
    m, want = small
    folder = str(tmp_path / "run")
    first = ProductRun(m, folder=folder, products=300)
    computed = []
    plain = ProductRun._cells

    def failing(self, tile):
        if len(computed) == 2:
            raise RuntimeError("killed")
        computed.append(tile.name)
        return plain(self, tile)

    monkeypatch.setattr(ProductRun, "_cells", failing)
    with pytest.raises(RuntimeError, match="killed"):
        first.run()
    with pytest.raises(ValueError, match="not complete"):
        first.result()
    assert set(first.committed()) == set(computed) == {t.name for t in first.tiles[:2]}
    before = first.committed()
    monkeypatch.setattr(ProductRun, "_cells", lambda self, tile: computed.append(tile.name) or plain(self, tile))
    second = ProductRun(m, folder=folder, products=300)
    assert second.run() == len(second.tiles) - 2 and second.run() == 0
    assert len(computed) == len(set(computed)) == len(second.tiles)
    assert {k: v for k, v in second.committed().items() if k in before} == before
    assert cells_of(second.result()) == want


@pytest.mark.parametrize("place", ["cells", "digests"])
def test_an_attempt_lost_inside_a_tile_is_never_read(small, tmp_path, monkeypatch, place):
    m, want = small
    folder = str(tmp_path / "run")
    run = ProductRun(m, folder=folder, products=300)
    plain, calls = execution.digests, []

    def half(cells):
        calls.append(1)
        if len(calls) == 2:
            if place == "digests":
                plain(cells).limit(1).write.parquet(f"{folder}/digests/{run.tiles[1].name}/half")
            raise RuntimeError("lost")
        return plain(cells)

    monkeypatch.setattr(execution, "digests", half)
    with pytest.raises(RuntimeError):
        run.run()
    monkeypatch.setattr(execution, "digests", plain)
    again = ProductRun(m, folder=folder, products=300)
    assert len(again.committed()) == 1
    again.run()
    assert cells_of(again.result()) == want and again.audit().count() == 0


def test_two_attempts_of_one_tile_count_once(small, tmp_path):
    m, want = small
    run = ProductRun(m, folder=str(tmp_path / "run"), products=300)
    run.run()
    run.compute(run.tiles[0])                  # as a second driver that did not see the first commit
    assert cells_of(run.result()) == want and run.result().count() == len(want)


def test_a_folder_belongs_to_one_product(small, matrix_of, tmp_path):
    m, _ = small
    ProductRun(m, folder=str(tmp_path / "run"), products=300)
    other = matrix_of([(0, 0, 1)], 30)
    for changed in (dict(a=other), dict(a=m, b=other), dict(a=m, products=99)):
        with pytest.raises(ValueError, match="other matrices"):
            ProductRun(**{"folder": str(tmp_path / "run"), "products": 300, **changed})


def test_too_many_tiles_are_refused(small, monkeypatch):
    m, _ = small
    monkeypatch.setattr(execution, "MAX_TILES", 3)
    with pytest.raises(ValueError, match="more than 3 tiles"):
        ProductRun(m, products=10)


def test_manifest_and_partial_results(small):
    m, want = small
    run = ProductRun(m, products=300)
    with pytest.raises(ValueError, match="no tile"):
        run.result(partial=True)
    run.run(most=2)
    rows = run.manifest().orderBy("begin_row").collect()
    assert [r["committed"] for r in rows] == [True, True] + [False] * (len(rows) - 2)
    end = run.tiles[1].end
    assert cells_of(run.result(partial=True)) == {k: v for k, v in want.items() if k[0] < end}


def test_audit_names_every_damage(small, tmp_path):
    m, want = small
    run = ProductRun(m, products=500, columns=16)
    run.run()
    assert run.audit().count() == 0
    cells = run.stored()
    r, c = F.col("r"), F.col("c")
    tile = {t.name: t for t in run.tiles}
    damaged = {
        "missing": cells.filter(r != 5),
        "foreign": cells.unionByName(cells.filter(r == 6).withColumn("r", F.lit(9).cast("long"))),
        "repeated": cells.unionByName(cells.filter(r == 7)).unionByName(cells.filter(r == 7)),
        "altered": cells.withColumn("v", F.when((r == 8) & (c < 16), -F.col("v")).otherwise(F.col("v"))),
    }
    row = {"missing": 5, "foreign": 9, "repeated": 7, "altered": 8}
    for problem, table in damaged.items():
        found = run.audit(table).collect()
        assert found and {(x["r"], x["problem"]) for x in found} == {(row[problem], problem)}
        assert all(x["tile"] in tile for x in found)
    lost = cells.filter(~((r == 8) & (c == min(k[1] for k in want if k[0] == 8))))
    assert {x["problem"] for x in run.audit(lost).collect()} <= {"altered", "missing"} and run.audit(lost).count() == 1


def test_empty_product(spark, matrix_of):
    m = matrix_of([(0, 1, 2)], 4)
    assert tiled_multiply(m).collect() == []
    run = ProductRun(m)
    run.run()
    assert run.audit().count() == 0


def test_many_small_tiles_share_jobs(small, tmp_path, monkeypatch):
    m, want = small
    monkeypatch.setattr(execution, "GROUPS", 3)
    folder = str(tmp_path / "run")
    run = ProductRun(m, folder=folder, products=40)
    computed, plain = [], ProductRun._cells
    monkeypatch.setattr(ProductRun, "_cells", lambda self, tile: computed.append(tile.name) or plain(self, tile))
    assert len(run.tiles) > 9 and run.run(most=4) == 4 and len(computed) <= 3
    assert set(run.committed()) == {t.name for t in run.tiles[:4]}
    again = ProductRun(m, folder=folder, products=40)
    assert again.run() == len(again.tiles) - 4 and len(computed) <= 8 and again.run() == 0
    again.compute(again.tiles[5])              # a second attempt of a tile inside a group
    assert cells_of(again.result()) == want and again.result().count() == len(want)
    assert {r["tile"] for r in again.stored().collect()} <= {t.name for t in again.tiles} and again.audit().count() == 0


def test_a_group_lost_before_its_commit_is_never_read(small, tmp_path, monkeypatch):
    m, want = small
    monkeypatch.setattr(execution, "GROUPS", 2)
    run = ProductRun(m, folder=str(tmp_path / "run"), products=40)
    plain = execution.digests

    def lost(cells):
        raise RuntimeError("lost")

    monkeypatch.setattr(execution, "digests", lost)
    with pytest.raises(RuntimeError):
        run.run()
    assert not run.committed()
    monkeypatch.setattr(execution, "digests", plain)
    run.run()
    assert cells_of(run.result()) == want and run.audit().count() == 0
