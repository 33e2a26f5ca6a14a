import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from matrel.llm import line_dedup, quality, secrets

from .helpers import SMALL, Forest, awkward, awkward_rows, base_statistics, edit_distance, nothing


def test_base_statistics(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.judge(docs).collect():
        want = base_statistics(texts[r["doc_id"]])
        assert tuple(r[1:6]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    for text in ("a b c a b c", "a a a a", "a b a b a", "x", "", "a b c d"):
        assert quality.text_statistics(text) == base_statistics(text)


def brute_verdicts(rows, share, least):
    lines = lambda t: [" ".join(x.split()) for x in t.lower().split("\n")]
    held, families = defaultdict(set), defaultdict(set)
    for i, source, text in rows:
        family = text.split("\n")[0]
        families[source].add(family)
        for line in set(lines(text)) - {""}:
            held[(source, line)].add(family)
    out = {}
    for i, source, text in rows:
        frequent = {line for line in lines(text) if line and len(held[(source, line)]) > max(least, share * len(families[source]))}
        removed = sum(len(line.split()) for line in lines(text) if line in frequent)
        out[i] = (removed, [k for k, line in enumerate(lines(text)) if line in frequent])
    return out


def test_boilerplate_lines_per_host(spark, monkeypatch):
    """Families are pinned to the first lines here, which are unique in each document."""
    rng = random.Random(3)
    prose = lambda k, n: " ".join(f"p{k}_{rng.randint(0, 10**9)}" for _ in range(n))
    rows = []
    for i in range(120):
        source = "hot" if i % 3 else "cold"
        parts = [prose(i, 60)] + ["Shared  notice of the host"] * (i % 2 == 0) + [f"seen in three {i % 40}"] + ["one two three four five six " * 30] * (i % 10 == 0)
        rows.append((i, source, "\n".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    # the least hash of a document may be a shared line's; so take documents whose own first line has the least
    got = {r["doc_id"]: r for r in quality.judge(docs, line_share=0.05, line_least=4).collect()}
    want = brute_verdicts(rows, 0.05, 4)
    long = [i for i in got if len(rows[i][2].split("\n")) > 3 or i % 10 == 0]
    for i, r in got.items():
        removed, places = want[i]
        assert (r["removed_words"], sorted(r["places"] or [])) == (removed, places), i
        assert r["kept"] == (not r["base_failed"] and r["n_words"] - removed >= 0.5 * r["n_words"])
    assert any(not got[i]["kept"] and not got[i]["base_failed"] for i in long) or all(got[i]["base_failed"] for i in long)
    cleaned = {r["doc_id"]: r["text"] for r in quality.clean(docs).collect()}
    assert set(cleaned) == {r["doc_id"] for r in quality.judge(docs).filter("kept").collect()}


def test_copies_are_no_boilerplate(spark):
    text = "\n".join(" ".join(f"w{k}_{j}" for j in range(15)) for k in range(8))
    near = [(i, "s", text.replace("w3_7", f"x{i}")) for i in range(60)]
    other = [(100 + i, "s", "\n".join(" ".join(f"o{i}_{k}_{j}" for j in range(15)) for k in range(8))) for i in range(40)]
    got = quality.judge(spark.createDataFrame(near + other, "doc_id long, source string, text string")).collect()
    assert all(r["kept"] for r in got)


def test_quality_of_awkward_rows(spark):
    got = quality.judge(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    sound = lambda n, *_, again: n >= 50 and 100 * again <= 50 * n
    statistics = [(r[0], base_statistics(r[1])) for r in awkward_rows()]
    assert Counter(r["doc_id"] for r in got if r["kept"]) == Counter(i for i, s in statistics if sound(s[0], again=s[4]))
    cleaned = quality.clean(awkward(spark))
    assert cleaned.columns == awkward(spark).columns and {r["doc_id"] for r in cleaned.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality.judge(nothing(spark)).count() == 0 and quality.clean(nothing(spark)).count() == 0


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        b = "".join(rng.choices("abc", k=rng.randint(0, 14))) if rng.random() < 0.3 else edited(rng, a, rng.randint(0, 5))
        for limit in (1, 2, 3, 5):
            assert line_dedup.within(a, b, limit) == (edit_distance(a, b) <= limit), (a, b, limit)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        kind, i = rng.randint(0, 2), rng.randint(0, len(out))
        if kind == 0:
            out.insert(i, rng.choice("abcd"))
        elif out and kind == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice("abcd")
    return "".join(out)


@pytest.mark.parametrize("limit", [1, 2, 3])
def test_linked_lines_share_a_segment(limit):
    rng = random.Random(limit)
    for _ in range(3000):
        a = "".join(rng.choices("abcd", k=rng.randint(8, 30)))
        b = edited(rng, a, limit)
        a, b = (a, b) if len(a) >= len(b) else (b, a)
        index = {(len(b), i, b[s:s + n]) for i, (s, n) in enumerate(line_dedup.segments(len(b), limit))}
        assert any((n, i, a[at:at + size]) in index for n, i, at, size in line_dedup.probes(len(a), limit))
        (c, p), (d, q) = line_dedup.parities(a), line_dedup.parities(b)
        assert bin((c ^ d) & 2**64 - 1).count("1") <= 2 * limit and bin((p ^ q) & 2**64 - 1).count("1") <= 4 * limit


def test_repeated_lines_match_brute_force(spark):
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdef gh", k=rng.randint(18, 40))).strip() for _ in range(30)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])).upper() if rng.random() < 0.5
                 else "".join(rng.choices("mnopqrst uvw", k=rng.randint(10, 60))) for _ in range(rng.randint(1, 12))]
        rows.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r for r in line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lines = [(i, k, " ".join(x.lower().split())) for i, t in rows for k, x in enumerate(t.split("\n"))]
    eligible = [x for x in lines if len(x[2]) >= 20]
    texts = sorted({x[2] for x in eligible})
    forest, degree = Forest(texts), Counter()
    for a in texts:
        for b in texts:
            if a < b and edit_distance(a, b) <= 2:
                forest.join(a, b)
                degree.update([a, b])
    first, again, links = {}, defaultdict(list), Counter()
    for i, k, x in eligible:
        c = forest.find(x)
        if c in first:
            again[i].append(k)
        first.setdefault(c, (i, k))
        links[i] += degree[x]
    for i, text in rows:
        words = [len(x.split()) for x in text.split("\n")]
        whole = sum(words[k] for k in again[i]) > 0.5 * sum(words)
        r = got[i]
        assert (r["n_lines"], r["n_links"], r["n_repeated"], r["whole"]) == (sum(x[0] == i for x in eligible), links[i], len(again[i]), whole)
        assert r["places"] == (sorted(again[i]) if again[i] and not whole else None)
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        gone = set(got[i]["places"] or [])
        assert kept[i] == "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)


def test_lines_of_awkward_rows(spark):
    got = line_dedup.repeated_lines(awkward(spark)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(awkward_rows())
    assert by_id[13]["whole"] and by_id[13]["n_repeated"] == 3 and by_id[14]["places"] == [0] and by_id[1]["n_lines"] == 0
    out = line_dedup.dedup_lines(awkward(spark))
    assert out.columns == awkward(spark).columns and out.count() == len(awkward_rows())
    assert {r["n_chars"] == len(r["text"]) for r in out.filter("doc_id in (13, 14)").collect()} == {True}
    assert out.filter("doc_id = 14").first()["text"] == awkward_rows()[-2][1].split("\n")[1]
    assert line_dedup.repeated_lines(nothing(spark)).count() == 0 and line_dedup.dedup_lines(nothing(spark)).count() == 0


def secret_rows(count=300):
    rng = random.Random(9)
    rows, truth = [], {}
    for i in range(count):
        before, after = (" ".join(rng.choices(["the", "of", "and", "store", "light"], k=20)) for _ in range(2))
        kind = i % 3
        value = "".join(rng.choices("0123456789abcdef", k=40)) if kind < 2 else "".join(rng.choices("0123456789", k=16))
        held = {0: f'token = "{value}"', 1: f"password: '{value}'", 2: f"number {value}"}[kind]
        rows.append((i, f"{before} {held} {after}", f"src{i % 5}", 7))
        truth[i] = (value, kind < 2)
    return rows, truth


def test_forest_tells_secrets_from_numbers_on_held_out_rows(spark):
    rows, truth = secret_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    train = docs.filter("doc_id < 200")
    labelled = secrets.label_findings(secrets.features(secrets.findings(train), secrets.dictionary(train)))
    got = {r["doc_id"]: (r["secret"], r["is_secret"]) for r in secrets.scan(docs.filter("doc_id >= 200"), labelled).collect()}
    assert len(got) == 100
    assert sum(got[i] == truth[i] for i in got) / len(got) >= 0.95
    redacted = secrets.redact(docs)
    for r in redacted.collect():
        value, is_secret = truth[r["doc_id"]]
        assert (value in r["text"]) != is_secret and (secrets.MARK in r["text"]) == is_secret
        assert r["n_chars"] == (len(r["text"]) if is_secret else 7)


def test_scan_runs_no_python_on_the_executors(spark):
    rows, _ = secret_rows(60)
    plan = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_secrets_of_awkward_rows(spark):
    got = secrets.scan(awkward(spark)).collect()
    assert {(r["doc_id"], r["secret"]) for r in got} == {(12, "04dbebab91ab85687d33eeaaf9ac699e1188f962"), (12, "4785380592391139")}
    out = secrets.redact(awkward(spark))
    assert out.columns == awkward(spark).columns and out.count() == len(awkward_rows())
    assert secrets.scan(nothing(spark)).count() == 0 and secrets.redact(nothing(spark)).count() == 0
    few = awkward(spark).filter("doc_id < 5")
    assert secrets.scan(few).count() == 0 and secrets.redact(few).filter(F.col("text").contains("SECRET")).count() == 0
