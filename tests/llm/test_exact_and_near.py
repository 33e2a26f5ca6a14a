import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel.llm import exact_dedup, near_dedup
from matrel.llm.components import components

from .helpers import PROSE, SMALL, Forest, awkward, awkward_rows, lower, near_components, nothing


def expected_exact(rows):
    size, keep = Counter(), {}
    for i, t in rows:
        t = lower(t)
        size[t] += 1
        if i is not None:
            keep[t] = max(keep.get(t, i), i)
    return Counter((i, keep.get(lower(t)), size[lower(t)], i == keep.get(lower(t)), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("hot", [1, 1000, 10**9])
def test_exact_groups_of_awkward_rows(spark, hot):
    got = exact_dedup.exact_dedup(awkward(spark), hot=hot)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert Counter(map(tuple, got.collect())) == expected_exact([r[:2] for r in awkward_rows()])
    assert exact_dedup.exact_dedup(nothing(spark)).count() == 0


def test_texts_under_one_digest_are_compared(spark, monkeypatch):
    plain = exact_dedup._digests
    monkeypatch.setattr(exact_dedup, "_digests", lambda docs: plain(docs).withColumn("digest", F.unhex(F.lit("00"))))
    rows = [(1, "a"), (2, "A"), (3, "b"), (4, "b"), (5, "c")]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {1: (2, 2), 2: (2, 2), 3: (4, 2), 4: (4, 2), 5: (5, 1)}


def test_keep_one_keeps_all_columns(spark):
    docs = awkward(spark)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    winners = {k[1] for k in expected_exact([r[:2] for r in awkward_rows()]) if k[1] is not None}
    assert sorted(r["doc_id"] for r in kept.filter("doc_id is not null").collect()) == sorted(winners)


def test_components_match_a_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 560)]
    forest = Forest({x for e in edges for x in e})
    for a, b in edges:
        forest.join(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in forest.parent} == {x: forest.find(x) for x in forest.parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(100)]
    for k in range(60):                          # copies of one base at similarities on both sides of the limit
        w = list(base)
        for i in rng.choice(100, k // 12, replace=False):
            w[i] = f"e{k}_{i}"
        texts[10_000 + k] = " ".join(w)
    shared = " ".join(f"s{i}" for i in range(60))
    for k in range(40):                          # one passage in unrelated texts
        texts[20_000 + k] = shared + " " + " ".join(f"u{k}_{i}" for i in range(50))
    want = near_components(texts)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(rows).collect()}
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n, c, i == c) for i, (n, c) in want.items()}
    kept = near_dedup.keep_one(rows)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if c == i}


def test_near_duplicates_of_awkward_rows(spark):
    got = near_dedup.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [by_id[i]["n_shingles"] for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by_id[i]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 9, 10)] == [1, 2, 3, 4, 4, 6, 7, 9, 9]
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert near_dedup.near_duplicates(nothing(spark)).count() == 0
    assert near_dedup.keep_one(awkward(spark)).columns == awkward(spark).columns


def test_keep_one_tells_texts_under_one_doc_id_apart(spark):
    near, other = PROSE + " tail", " ".join(f"v{i}" for i in range(60))
    rows = [(1, PROSE), (2, near), (2, other), (2, other), (3, PROSE), (None, near), (None, "alone here"), (None, "alone here"), (4, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, node int")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str)
    assert got == sorted([(1, PROSE), (2, other), (None, "alone here"), (4, ""), (5, "")], key=str)


def test_signatures_estimate_the_similarity():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])          # similarity 0.6
    one = near_dedup.signature(a, rows=1, bands=400)
    two = near_dedup.signature(b, rows=1, bands=400)
    assert abs((one == two).mean() - 0.6) < 0.08


def test_late_links_join_sets_to_members_that_can_be_linked_only(spark, monkeypatch):
    staged, plain = [], near_dedup.stage

    def counted(df):
        df = plain(df)
        if "shingles" in df.columns:
            staged.append(df.count())
        return df

    monkeypatch.setattr(near_dedup, "stage", counted)
    sets = {0: range(0, 100), 1: range(0, 80), 2: range(500, 540), 3: range(500, 900), 4: range(2000, 2003), 5: range(10, 95)}
    # 0, 1 and 5 are of nearly one size; 2, 3 and 4 are too far from the others and from each other
    hits = [(b, i, i, len(s), len(s)) for b, nodes in ((7, [0, 1, 2, 3, 4]), (3, [0, 1, 2, 5]), (9, [3, 4, 5])) for i in nodes for s in (sets[i],)]
    hits = spark.createDataFrame(hits, "bucket long, node long, component long, size int, shared int")
    rows = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "node long, shingles array<long>")
    got = {(r["a"], r["b"]) for r in near_dedup._late_links(hits, rows, 75).collect()}
    alike = lambda a, b: 100 * len(set(sets[a]) & set(sets[b])) >= 75 * len(set(sets[a]) | set(sets[b]))
    assert got == {(0, 1), (0, 5)} | ({(1, 5)} if alike(1, 5) else set())
    assert staged == [3]             # bucket 3 holds all pairs that sizes allow; twelve rows had sets before


def test_only_the_tables_that_the_result_reads_stay_staged(spark, monkeypatch, tmp_path):
    import os

    from matrel import session

    monkeypatch.setattr(session, "shared_folder", lambda _: f"file://{tmp_path}")
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j}" for j in range(40)) + f" end{i}") for i in range(30)]
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(any(x.endswith(".parquet") for x in files) for _, _, files in os.walk(tmp_path)) == 2
    assert {r["component_id"] for r in out.collect()} == set(range(0, 30, 3))
