import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), ".."))

from matrel.operators.coo import Matrix  # noqa: E402
from matrel.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "6g", "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from matrel.sources.tables import Tables

    return Tables(spark, SMALL)


@pytest.fixture
def matrix_of(spark):
    def build(cells, n):
        rows = [(int(r), int(c), float(v)) for r, c, v in cells]
        return Matrix(spark.createDataFrame(rows, "r long, c long, v double"), n)

    return build


def cells_of(df):
    return {(row["r"], row["c"]): row["v"] for row in df.select("r", "c", "v").collect()}


def brute_product(a, b, keep_structural=False):
    by_row = {}
    for k, c, v in b:
        by_row.setdefault(k, []).append((c, v))
    out = {}
    for r, k, v in a:
        for c, w in by_row.get(k, ()):
            out[(r, c)] = out.get((r, c), 0.0) + v * w
    return out if keep_structural else {k: v for k, v in out.items() if v != 0}
