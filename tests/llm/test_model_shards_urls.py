import fnmatch
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from matrel.llm import hmm, sharding, url_filter

from .helpers import SMALL, awkward, awkward_rows, nothing


@pytest.fixture
def model():
    rng = np.random.default_rng(3)
    return hmm.Model(rng.dirichlet(np.ones(4)), rng.dirichlet(np.ones(4), 4), rng.dirichlet(np.ones(30), 4))


def test_likelihood_equals_the_plain_forward_pass(model):
    rng = np.random.default_rng(5)
    sequences = [rng.integers(0, 30, n) for n in (1, 2, 127, 128, 129, 1000, 3)]
    for s, got in zip(sequences, model.log10(sequences)):
        state, log = model.start * model.emit[:, s[0]], 0.0
        for x in s[1:]:
            log += math.log10(state.sum())
            state = (state / state.sum()) @ model.move * model.emit[:, x]
        assert math.isclose(got, log + math.log10(state.sum()), rel_tol=1e-10)


def test_counts_equal_plain_baum_welch(model):
    rng = np.random.default_rng(6)
    parts = [rng.integers(0, 30, n) for n in (7, 9, 1, 7, 3)]
    start, move, emit = np.zeros(4), np.zeros((4, 4)), np.zeros((4, 30))
    for x in parts:
        n = len(x)
        a, b = np.zeros((n, 4)), np.ones((n, 4))
        a[0] = model.start * model.emit[:, x[0]]
        for t in range(1, n):
            a[t] = a[t - 1] @ model.move * model.emit[:, x[t]]
        for t in range(n - 2, -1, -1):
            b[t] = model.move @ (model.emit[:, x[t + 1]] * b[t + 1])
        p = a[-1].sum()
        start += a[0] * b[0] / p
        for t in range(n):
            emit[:, x[t]] += a[t] * b[t] / p
        for t in range(n - 1):
            move += a[t][:, None] * model.move * (model.emit[:, x[t + 1]] * b[t + 1])[None] / p
    for got, want in zip(model.counts(parts, 12), (start, move, emit)):
        assert np.allclose(got, want)


@pytest.mark.parametrize("known", [150_000, 300])
def test_scores(spark, monkeypatch, known):
    monkeypatch.setattr(hmm, "KNOWN", known)
    monkeypatch.setattr(hmm, "SYMBOLS", 200)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r["doc_id"]: r for r in hmm.score_documents(docs, passes=3).collect()}
    texts = {r["doc_id"]: r["text"].encode().lower().split() + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    counts = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
    out = [got[i] for i in texts if held[i]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_word_probabilities_sum_to_one():
    counts = {b"aa": 5, b"ba": 2, b"cd": 1}
    kinds = Counter(hmm.spelling(w) for w in counts)
    tokens, types = np.zeros(hmm.SPELLINGS), np.zeros(hmm.SPELLINGS)
    for w, c in counts.items():
        tokens[hmm.spelling(w)] += c
        types[hmm.spelling(w)] += 1
    lexicon = hmm.Lexicon({}, counts, tokens, types)
    for kind in kinds:
        inside = [10 ** lexicon.inside[row] for w, row in lexicon.rows.items() if hmm.spelling(w) == kind]
        assert math.isclose(sum(inside) + 10 ** -lexicon.rest[kind], 1.0)


def test_scores_of_awkward_rows(spark):
    got = hmm.score_documents(awkward(spark), passes=1).collect()
    assert len(got) == len(awkward_rows()) and all(math.isfinite(r["score"]) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    assert hmm.score_documents(nothing(spark), passes=1).count() == 0


def check_shards(rows, docs, shards, off=2):
    n = len(docs)
    assert len(rows) == n and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}
    sizes = Counter(r["shard"] for r in rows)
    assert all(sizes[s] in (n // shards, -(-n // shards)) for s in range(shards)) and max(sizes, default=0) < shards
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    per_source = Counter(s for _, _, s in docs)
    mixture = Counter((r["shard"], r["source"]) for r in rows)
    for s in range(shards):
        for source, m in per_source.items():
            assert abs(mixture[(s, source)] - m / shards) <= off


@pytest.mark.parametrize("slice_rows", [20_000, 7])
def test_shards(spark, slice_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sharding.interleave(docs, slice_rows=slice_rows).collect()
    check_shards(rows, [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], 40)
    if slice_rows == 7:
        whole = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(docs).collect()}
        assert whole == {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}


def test_small_sources_spread_over_all_shards(spark):
    rows = [(i, f"t{i}", "large") for i in range(1000)] + [(1000 + i, f"t{i}", f"small{i}") for i in range(1000)]
    rows += [(None, f"n{i}", "null ids") for i in range(200)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    check_shards(got, rows, 40, off=3)
    small = Counter(r["shard"] for r in got if r["source"].startswith("small"))
    assert len(small) == 40 and max(small.values()) <= 28 and min(small.values()) >= 22


def test_shards_of_awkward_rows(spark):
    rows = sharding.interleave(awkward(spark), shards=4).collect()
    check_shards(rows, [(r[0], r[1], r[3]) for r in awkward_rows()], 4)
    assert sharding.interleave(nothing(spark)).count() == 0


def test_wildcards_match_a_plain_matcher():
    rng = random.Random(2)
    globs = ["", "*", "a*", "*a", "a?b*", "*ab*ba*", "??", "abc"] + ["".join(rng.choices("ab*?", k=rng.randint(1, 40))) for _ in range(60)]
    texts = ["", "a", "ab", "abc"] + ["".join(rng.choices("abcé", k=rng.randint(0, 60))) for _ in range(300)]
    found = url_filter.WildcardAutomaton(globs).match(texts)
    for i, text in enumerate(texts):
        for j, glob in enumerate(globs):
            assert found[i, j] == fnmatch.fnmatchcase(text, glob), (text, glob)


def test_url_rules(spark):
    urls = [
        ("http://a.example.com/en/1", "block"), ("http://www.example.com/en/1", "allow"), ("HTTP://X.WWW.Example.COM/en/", "allow"),
        ("http://example.com/fr/", "allow"), ("http://badexample.com/en/", "allow"), ("http://x.net/es/9", "block"), ("http://x.net/fr/9?q", "block"),
        ("http://x.net/EN", "allow"), ("http://x.com", "allow"), ("http://cheap-pills.org/x", "block"), ("http://a.org/cheap-pills/.example.com/en/", "allow"),
        ("http://x.org?a=.net/es/", "allow"), (None, "allow"), ("", "allow"), ("no scheme.net/es/", "allow"), ("://net/es/", "block"),
        ("http://u@x.net:80/es/", "allow"), ("http://x.net/es/" + "a" * 100_000, "block"), ("http://x.net/es/1", "block"), ("http://x.net/es/1", "block"),
    ]
    rows = [(None if i == 3 else i, u, "html", "v") for i, (u, _) in enumerate(urls)]
    got = url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, verdict string")).collect()
    assert len(got) == len(urls)
    by_id = {r["page_id"]: r for r in got}
    for i, (url, verdict) in enumerate(urls):
        r = by_id[None if i == 3 else i]
        assert r["verdict"] == verdict, url
        assert (r["host"], r["path"]) == url_filter.split_url(url)
    assert by_id[0]["rule"] == "example.com/en/" and by_id[9]["rule"] is None and by_id[12]["host"] == by_id[12]["path"] == ""
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
