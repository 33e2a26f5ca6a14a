"""Windows, compressed rows, verification, report and the registered queries."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from matrel import multiply, report
from matrel.operators import csr, verify


def test_row_pointers_and_packed_rows(matrix_of):
    m = matrix_of([(0, 3, 1), (0, 1, 2), (2, 0, 5)], 4)
    got = [tuple(x) for x in csr.row_pointers(m.entries, 4).orderBy("r").collect()]
    assert got == [(0, 2, 0, 2), (1, 0, 2, 2), (2, 1, 2, 3), (3, 0, 3, 3)]
    packed = {(x["r"], x["w"]): (x["columns"], x["values"]) for x in csr.packed_rows(m.entries, 2).collect()}
    assert packed == {(0, 0): ([1], [2.0]), (0, 1): ([3], [1.0]), (2, 0): ([0], [5.0])}
    assert csr.descending_steps(csr.packed_rows(m.entries)).count() == 0


def test_descending_columns_are_found(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [2, 2]), (2, [3, 1]), (3, [5]), (4, [])], "r long, columns array<long>")
    assert sorted(x["r"] for x in csr.descending_steps(df).collect()) == [1, 2]


def test_violations(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (1, 9, 1.0), (2, 2, 0.0), (1, 1, 1.0)], "r long, c long, v double")
    assert {(x["r"], x["c"]): x["problem"] for x in csr.violations(df, 3).collect()} == {
        (0, 0): "duplicate", (1, 9): "out of range", (2, 2): "stored zero"}


def test_verification_finds_wrong_missing_and_extra_cells(matrix_of):
    m = matrix_of([(0, 1, 30.0), (1, 2, 40.0), (1, 1, 2.0), (2, 0, 7.0)], 3)
    good = multiply(m, mode="merge")
    assert verify.report(verify.verify(m, good), 3).first()["mismatches"] == 0
    wrong = good.withColumn("v", F.when((F.col("r") == 0) & (F.col("c") == 2), F.col("v") + 1).otherwise(F.col("v")))
    missing = good.filter("NOT (r = 0 AND c = 2)")
    extra = good.unionByName(good.sparkSession.createDataFrame([(2, 2, 1.0)], "r long, c long, v double"))
    nan = good.withColumn("v", F.when(F.col("r") == 0, float("nan")).otherwise(F.col("v")))
    for bad in (wrong, missing, extra, nan):
        assert verify.report(verify.verify(m, bad), 3).first()["mismatches"] >= 1


def test_fingerprints_tell_structures_apart(matrix_of):
    a = matrix_of([(0, 1, 1), (1, 2, 1)], 3).entries
    b = matrix_of([(0, 1, 9), (1, 0, 1), (2, 2, 1)], 3).entries
    assert sorted(x["r"] for x in csr.differing_rows(a, b).select(F.coalesce("r", F.lit(2)).alias("r")).collect()) == [1, 2]


def test_report(spark, tmp_path):
    m = spark.range(10)
    runs = {mode: (lambda: m) for mode in report.MODE_ORDER}
    results = report.time_modes(spark, "x", runs, repetitions=2)
    report.check_results(results, 2)
    with pytest.raises(ValueError):
        report.check_results(results, 3)
    with pytest.raises(ValueError):
        report.check_results(results.filter("mode <> 'dense_only'"), 2)
    fixed = spark.createDataFrame([("x", "row_adaptive", "TOTAL", 4.0), ("x", "dense_only", "TOTAL", 2.0)], "matrix string, mode string, batch string, ms double")
    base = spark.createDataFrame([("x", 8.0), ("x", 6.0)], "matrix string, baseline_ms double")
    row = report.compare_modes(fixed, base).first()
    assert (row["oracle_mode"], row["regret_pct"], row["selected_speedup"], row["oracle_speedup"]) == ("dense_only", 100.0, 1.5, 3.0)
    assert report.means(report.compare_modes(fixed, base)).first()["mean_regret_pct"] == 100.0
    report.write_results(results, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == results.count()
    report.write_product(multiply_source(spark), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3


def multiply_source(spark):
    return spark.createDataFrame([(0, 0, 1.0), (1, 1, 2.0), (2, 2, 3.0)], "r long, c long, v double")


SAMPLED = ["spgemm_merge", "spgemm_dense", "spgemm_adaptive", "spgemm_auto", "plan_summary", "row_batches",
           "csr_violations_damaged", "verify_range", "hll16_estimate", "csr_rowptr", "verify_report", "matrix_market_skew"]


@pytest.mark.parametrize("name", SAMPLED)
def test_queries_equal_their_sql(spark, name):
    import os
    import sys

    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))
    from compare import compare, connect

    ok, note = compare(spark, connect(SMALL), name, SMALL)
    assert ok, note


def test_every_query_has_sql():
    import __spark_entry__ as entry

    corpus = set(entry.corpus.queries()) | {"pipeline"} if entry.corpus else set()
    assert set(entry.queries()) - corpus == set(entry.oracle_sql()) - corpus


def test_command_line(spark, tables, tmp_path, capsys):
    from matrel.__main__ import arguments, run

    path = tables.market_text("cust")
    assert run(spark, arguments([path, "--dry-run"])) == 0
    out, product = str(tmp_path / "csv"), str(tmp_path / "c")
    assert run(spark, arguments([path, "--reps", "1", "--out", out, "--product", product, "--rows", "0", "50"])) == 0
    rows = spark.read.option("header", True).csv(out)
    assert rows.filter("batch = 'TOTAL'").count() == 3
    stored = spark.read.parquet(product)
    assert stored.exceptAll(multiply(tables.matrix("cust"), mode="merge", rows=(0, 50))).count() == 0
    assert "'mismatches': 0" in capsys.readouterr().out


def test_a_wrong_row_outside_any_sample_is_found(spark):
    cells = spark.range(4000).select(F.col("id").alias("r"), ((F.col("id") * 7) % 4000).alias("c"), F.lit(2.0).alias("v"))
    from matrel.operators.coo import Matrix

    m = Matrix(cells, 4000)
    wrong = multiply(m, mode="merge").withColumn("v", F.when(F.col("r") == 3, F.col("v") + 1000).otherwise(F.col("v")))
    assert 3 not in {x["r"] for x in verify.sampled_rows(spark, 4000, 512).collect()}
    full = verify.report(verify.verify(m, wrong), m.n).first()
    assert (full["mismatches"], full["checked_rows"], full["total_rows"]) == (1, 4000, 4000)
    part = verify.report(verify.verify(m, wrong, sample_rows=512), m.n, 512).first()
    assert (part["mismatches"], part["checked_rows"], part["total_rows"]) == (0, 512, 4000)


def test_sampled_rows_are_evenly_spaced(spark):
    rows = sorted(x["r"] for x in verify.sampled_rows(spark, 100_000, 512).collect())
    assert rows == sorted({i * 99_999 // 511 for i in range(512)})


def test_fingerprints_tell_far_columns_apart(spark):
    rows = [(0, 5), (1, 5 + 2**32), (2, 5 + 2**40)]
    got = csr.fingerprints(spark.createDataFrame(rows, "r long, c long")).collect()
    assert len({x["fp_xor"] for x in got}) == 3 and len({x["fp_sum"] for x in got}) == 3


def test_tiles_unite_to_the_product(tables):
    from matrel.execution import tiled_multiply

    m = tables.matrix("cust")
    whole, tiled = multiply(m, mode="merge"), tiled_multiply(m, rows=60, columns=90, mode="merge")
    assert whole.exceptAll(tiled).count() == 0 and tiled.exceptAll(whole).count() == 0


def test_released_files_are_gone(spark, monkeypatch, tmp_path):
    import os

    from matrel import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    session.stage(spark.range(3)).count()
    assert os.listdir(tmp_path)
    session.release(spark)
    assert not os.listdir(tmp_path)


def test_scratch_keeps_what_it_is_told_to(spark, monkeypatch, tmp_path):
    import os

    from matrel import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    with session.scratch(spark) as keep:
        with session.scratch(spark) as inner:
            one, two = session.stage(spark.range(3)), inner(session.stage(spark.range(4).repartition(3)))
        three = keep(session.stage(two))
    left = {x for d, _, files in os.walk(tmp_path) for x in [d] if files}
    assert left == {three.staged_at.removeprefix("file://")} and three.count() == 4 and one.staged_at not in left
