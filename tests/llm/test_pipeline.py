import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import corpus_pipeline  # noqa: E402
from matrel.llm import queries as corpus  # noqa: E402

from .helpers import DOCUMENTS, SMALL, awkward, nothing  # noqa: E402


def test_stages_are_the_named_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]


def test_each_stage_keeps_the_columns_and_the_last_packs_all(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns
            assert docs.join(before, "doc_id", "left_anti").count() == 0 and docs.count() <= kept
            kept = docs.count()
    assert docs.select("doc_id").distinct().count() == kept
    whole = corpus_pipeline.run(spark, SMALL).groupBy().sum("length").first()[0]
    assert whole == docs.groupBy().sum("length").first()[0]


@pytest.mark.parametrize("table", [awkward, nothing])
def test_stages_take_awkward_tables(spark, tmp_path, table):
    docs = table(spark)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        assert i == 4 or docs.columns == DOCUMENTS.names


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in corpus.queries()} == {f"op{i}" for i in range(1, 14)} and set(corpus.queries()) | {"pipeline"} <= names


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_queries_equal_their_sql(spark, name):
    from compare import compare, connect

    ok, note = compare(spark, connect(SMALL), name, SMALL)
    assert ok, note
