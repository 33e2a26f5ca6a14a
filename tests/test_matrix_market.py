"""Matrix Market texts: symmetry, duplicates, comments and errors."""

import pytest
from conftest import cells_of

from matrel.sources.matrix_market import MatrixMarketError, read_matrix_market

HEAD = "%%MatrixMarket matrix coordinate {} {}\n"


@pytest.fixture
def load(spark, tmp_path):
    def read(text):
        path = tmp_path / "m.mtx"
        path.write_text(text)
        return read_matrix_market(spark, str(path))

    return read


def test_general_with_comments_and_blank_lines(load):
    m = load(HEAD.format("real", "general") + "% one\n\n3 3 3\n1 1 2.5\n\n% two\n 2   3\t-1e3 \n3 1 4 trailing\n")
    assert m.n == 3
    assert cells_of(m.entries) == {(0, 0): 2.5, (1, 2): -1000.0, (2, 0): 4.0}


def test_pattern_counts_as_one(load):
    assert cells_of(load(HEAD.format("pattern", "general") + "2 2 2\n1 2\n2 2\n").entries) == {(0, 1): 1.0, (1, 1): 1.0}


@pytest.mark.parametrize("kind,sign", [("symmetric", 1), ("hermitian", 1), ("skew-symmetric", -1)])
def test_mirrored_forms(load, kind, sign):
    got = cells_of(load(HEAD.format("real", kind) + "3 3 2\n1 1 5\n3 1 2\n").entries)
    assert got == {(0, 0): 5.0, (2, 0): 2.0, (0, 2): sign * 2.0}


def test_duplicates_sum_and_cancel_and_zeros_drop(load):
    got = cells_of(load(HEAD.format("integer", "general") + "2 2 6\n1 1 1\n1 1 2\n1 2 3\n1 2 -3\n2 1 0\n2 2 nan\n").entries)
    assert got[(0, 0)] == 3.0 and (0, 1) not in got and (1, 0) not in got and got[(1, 1)] != got[(1, 1)]


def test_entries_spelled_like_the_size_line(load):
    assert cells_of(load(HEAD.format("real", "general") + "3 3 3\n3 3 3\n1 1 1\n3 3 3\n").entries) == {(2, 2): 6.0, (0, 0): 1.0}


@pytest.mark.parametrize("text", [
    "%%MatrixMarket matrix array real general\n2 2\n1\n",
    HEAD.format("complex", "general") + "1 1 1\n1 1 1 0\n",
    HEAD.format("real", "general") + "2 3 1\n1 1 1\n",
    HEAD.format("real", "general") + "0 0 0\n",
    HEAD.format("real", "general") + "2 2 1\n0 1 1\n",
    HEAD.format("real", "general") + "2 2 1\n1 3 1\n",
    HEAD.format("real", "general") + "2 2 2\n1 1 1\n",
    HEAD.format("real", "general") + "2 2 1\n1 1 1\n2 2 9\n",
    HEAD.format("real", "general") + "2 2 1\n1 1\n",
    HEAD.format("real", "general") + "2 2 1\n1 x 1\n",
    HEAD.format("real", "general"),
])
def test_malformed_texts(load, text):
    with pytest.raises(MatrixMarketError):
        load(text)


def test_folder_of_parts(tables, spark):
    m = tables.matrix("cust")
    again = read_matrix_market(spark, tables.market_text("cust"))
    assert again.n == m.n and again.entries.exceptAll(m.entries).count() == 0
    assert m.entries.exceptAll(again.entries).count() == 0


def test_large_indices(load):
    m = load(HEAD.format("real", "general") + "6000000000 6000000000 1\n5000000000 1 2\n")
    assert m.n == 6_000_000_000 and cells_of(m.entries) == {(4_999_999_999, 0): 2.0}
