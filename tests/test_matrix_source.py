"""The mtx format: byte ranges, compressed parts, pushed filters, two-phase writing."""

import gzip
import os
import random

import pytest
from conftest import cells_of
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from matrel.operators.coo import Matrix, canonical, mirrored
from matrel.sources import matrix_market as mm

HEAD = "%%MatrixMarket matrix coordinate {} {}\n"


@pytest.fixture
def mtx(spark):
    mm.register(spark)
    return lambda path, **options: spark.read.format("mtx").options(**options).load(str(path))


def text_of(n, entries, kind="general", seed=1):
    """Entries with comments, blank lines and odd spacing between them."""
    rnd, lines = random.Random(seed), []
    for r, c, v in entries:
        lines.append(rnd.choice(["{} {} {}", " {}\t{}  {} ", "{} {} {} more", "+{} {} +{}"]).format(r + 1, c + 1, v))
        lines += rnd.choice([[], [], [""], ["% note " + "x" * rnd.randrange(40)], ["\r"]])
    return HEAD.format("real", kind) + f"% c\n\n{n} {n} {len(entries)}\n" + "\n".join(lines)


def some(n, count, seed=0):
    rnd = random.Random(seed)
    return sorted({(rnd.randrange(n), rnd.randrange(n)): rnd.randrange(1, 99) for _ in range(count)}.items())


@pytest.mark.parametrize("split", [1, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["", "\n"])
def test_every_line_belongs_to_one_range(mtx, tmp_path, split, end):
    entries = [(r, c, v) for (r, c), v in some(40, 60 if split > 1 else 12)]
    (tmp_path / "m.mtx").write_text(text_of(40, entries) + end)
    reader = mm.MatrixMarketReader({"path": str(tmp_path / "m.mtx"), "split_bytes": str(split)})
    got = [row for span in reader.partitions() for batch in reader.read(span) for row in zip(*(c.to_pylist() for c in batch.columns))]
    assert got == [(r, c, float(v)) for r, c, v in entries]


def test_ranges_through_spark_equal_one_read(mtx, tmp_path):
    entries = [(r, c, v) for (r, c), v in some(300, 900)]
    (tmp_path / "m.mtx").write_text(text_of(300, entries))
    df = mtx(tmp_path / "m.mtx", split_bytes=700)
    assert df.rdd.getNumPartitions() > 10
    assert cells_of(df) == {(r, c): float(v) for r, c, v in entries}


def test_compressed_and_plain_parts_in_one_folder(mtx, tmp_path):
    entries = [(r, c, v) for (r, c), v in some(50, 80)]
    lines = text_of(50, entries).encode()
    cut = lines.index(b"\n", len(lines) // 2) + 1
    (tmp_path / "part-0.mtx.gz").write_bytes(gzip.compress(lines[:cut]))
    (tmp_path / "part-1.mtx").write_bytes(lines[cut:])
    (tmp_path / "_SUCCESS").write_text("")
    assert cells_of(mtx(tmp_path)) == {(r, c): float(v) for r, c, v in entries}


def test_size_line_in_a_later_part(spark, tmp_path):
    (tmp_path / "a.mtx").write_text(HEAD.format("real", "general") + "% long comment\n")
    (tmp_path / "b.mtx").write_text("% more\n2 2 1\n2 1 5\n")
    assert cells_of(mm.read_matrix_market(spark, str(tmp_path)).entries) == {(1, 0): 5.0}


def test_filters_go_to_the_source_after_mirroring(mtx, tmp_path):
    entries = [(r, c, v) for (r, c), v in some(60, 200) if r >= c]
    (tmp_path / "m.mtx").write_text(text_of(60, entries, "skew-symmetric"))
    whole = cells_of(mtx(tmp_path / "m.mtx"))
    df = mtx(tmp_path / "m.mtx").filter((F.col("r") >= 10) & (F.col("r") < 30) & F.col("c").isin(1, 5, 20, 40))
    assert cells_of(df) == {k: v for k, v in whole.items() if 10 <= k[0] < 30 and k[1] in (1, 5, 20, 40)} != {}
    reader = mm.MatrixMarketReader({"path": str(tmp_path / "m.mtx")})
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan, Not
    left = list(reader.pushFilters([GreaterThanOrEqual(("r",), 10), Not(In(("c",), (1,))), LessThan(("v",), 3.0)]))
    assert [type(f) for f in left] == [Not, LessThan]
    assert all(row >= 10 for span in reader.partitions() for batch in reader.read(span) for row in batch.column("r").to_pylist())


def test_range_filter_leaves_no_filter_above_the_scan(mtx, tmp_path):
    (tmp_path / "m.mtx").write_text(text_of(5, [(1, 2, 3), (4, 0, 1)]))
    plan_of = lambda test: mtx(tmp_path / "m.mtx").filter(test)._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan_of("r > 2 AND c IN (0, 2)") and "BatchScan mtx" in plan_of("r > 2")
    kept = plan_of("r > 2 AND v > 1")
    assert "v#" in kept.split("Filter (")[1].split("\n")[0] and "r#" not in kept.split("Filter (")[1].split("\n")[0]


def test_a_bad_line_fails_the_read(mtx, tmp_path):
    (tmp_path / "m.mtx").write_text(HEAD.format("real", "general") + "3 3 2\n1 1 1\n1 9 1\n")
    with pytest.raises(PySparkException, match="MatrixMarketError"):
        mtx(tmp_path / "m.mtx").collect()


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_written_and_read_back(spark, tables, tmp_path, compression):
    m = tables.matrix("cust")
    m = Matrix(m.entries.withColumn("v", F.col("v") / 7 - 1e-9).repartition(5), m.n)
    path = str(tmp_path / "out")
    mm.write_matrix_market(m, path, compression=compression)
    names = sorted(os.listdir(path))
    assert len(names) == 6 and not any(n.startswith("_") for n in names)
    again = mm.read_matrix_market(spark, path)
    assert again.n == m.n and cells_of(again.entries) == cells_of(m.entries)
    # the parts in order are one valid file
    data = b"".join(open(os.path.join(path, n), "rb").read() for n in names)
    single = tmp_path / ("one.mtx.gz" if compression == "gzip" else "one.mtx")
    single.write_bytes(data)
    assert cells_of(mm.read_matrix_market(spark, str(single)).entries) == cells_of(m.entries)


@pytest.mark.parametrize("kind,sign", [("symmetric", 1), ("skew-symmetric", -1)])
def test_symmetric_forms_are_checked_and_written_by_half(spark, tables, tmp_path, kind, sign):
    m = tables.matrix("cust")
    lower = m.entries.filter(F.col("r") > F.col("c") if sign < 0 else F.col("r") >= F.col("c"))
    whole = Matrix(canonical(mirrored(lower, sign)), m.n)
    path = str(tmp_path / kind)
    mm.write_matrix_market(whole, path, symmetry=kind, field="integer")
    assert mm.read_header(path).entries == lower.count()
    assert cells_of(mm.read_matrix_market(spark, path).entries) == cells_of(whole.entries)
    with pytest.raises(mm.MatrixMarketError):
        mm.write_matrix_market(m, str(tmp_path / "no"), symmetry=kind)


def test_pattern_empty_matrix_and_limits_of_the_writer(spark, tmp_path, matrix_of):
    mm.write_matrix_market(matrix_of([(0, 1, 5), (2, 2, 7)], 3), str(tmp_path / "p"), field="pattern")
    assert cells_of(mm.read_matrix_market(spark, str(tmp_path / "p")).entries) == {(0, 1): 1.0, (2, 2): 1.0}
    empty = spark.createDataFrame([], "r long, c long, v double")
    mm.write_matrix_market(Matrix(empty, 4), str(tmp_path / "e"))
    again = mm.read_matrix_market(spark, str(tmp_path / "e"))
    assert again.n == 4 and again.entries.count() == 0
    for bad, n in (([(0, 3, 1.0)], 3), ([(0, None, 1.0)], 3)):
        df = spark.createDataFrame(bad, "r long, c long, v double")
        with pytest.raises(PySparkException, match="MatrixMarketError"):
            df.write.format("mtx").option("n", n).mode("append").save(str(tmp_path / "bad"))
        assert not os.path.exists(tmp_path / "bad") or os.listdir(tmp_path / "bad") == []


def test_a_matrix_is_not_appended_to_but_can_be_replaced(spark, tmp_path, matrix_of):
    path = str(tmp_path / "m")
    mm.write_matrix_market(matrix_of([(0, 0, 1)], 2), path)
    with pytest.raises(PySparkException, match="cannot be appended"):
        mm.write_matrix_market(matrix_of([(1, 1, 2)], 2), path)
    matrix_of([(1, 0, 3)], 2).entries.write.format("mtx").mode("overwrite").save(path)
    again = mm.read_matrix_market(spark, path)
    assert again.n == 2 and cells_of(again.entries) == {(1, 0): 3.0}
