import hashlib
import random
from fractions import Fraction
from zlib import crc32

import pytest

from matrel.llm import runs
from tests.llm.helpers import SMALL, awkward, nothing, words


def brute_runs(w, least=24, periods=3):
    n, out = len(w), []
    for p in range(1, n // periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(least, periods * p):
                part = w[i:i + size]
                if not any(part[q:] == part[:-q] for q in range(1, p)):
                    out.append((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def repeated(doc_id, w):
    n = len(w)
    h = crc32(str(doc_id).encode())
    if h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute_row(doc_id, text):
    w = words(text)
    if doc_id is not None:
        w = repeated(doc_id, w)
    found = brute_runs(w)
    dropped = {i for s, n, p in found for i in range(s + p, s + n)}
    best = max(found, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in dropped)))


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_words_with_planted_repetitions(seed):
    rnd = random.Random(seed)
    for _ in range(120):
        n, letters = rnd.randint(0, 200), rnd.choice([1, 2, 2, 3, 60])
        w = [rnd.randrange(letters) for _ in range(n)]
        if n > 40:
            a, p = rnd.randrange(n // 2), 1 + rnd.randrange(n // 6)
            for i in range(a, min(n, a + p * rnd.randint(3, 9) + rnd.randrange(p))):
                w[i] = w[a + (i - a) % p]
        want = brute_runs(w)
        assert runs.find_runs(w) == want
        # the automaton alone finds the same over the whole text
        assert sorted(((s, n, p) for (s, p), n in runs.runs_of(w).items()), key=lambda x: (x[0], x[2])) == want


def test_fibonacci_words_and_other_limits():
    x, y = [0], [0, 1]
    while len(y) < 600:
        x, y = y, y + x
    for least, periods in ((24, 3), (16, 2)):
        assert runs.find_runs(y, least, periods) == brute_runs(y, least, periods)
    with pytest.raises(ValueError):
        runs.find_runs(y, 10, 2)


def test_a_long_text_of_one_word_and_of_one_period():
    assert runs.find_runs([b"a"] * 50_000) == [(0, 50_000, 1)]
    w = [str(i) for i in range(700)] * 60
    assert runs.find_runs(w + ["end"]) == [(0, 42_000, 700)]


def test_overlapping_runs_are_both_kept():
    w = [1, 2, 3] * 12 + [1, 2, 4, 5] * 9
    found = runs.find_runs(w)
    assert found == brute_runs(w) and len(found) == 2
    kept = runs.collapsed(w, found)
    assert kept == [x for i, x in enumerate(w) if not any(s + p <= i < s + n for s, n, p in found)]


def test_digests_of_a_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = sorted(brute_row(d["doc_id"], d["text"]) for d in docs.collect() if len(words(d["text"])) < 1500)
    ids = {w[0] for w in want}
    got = sorted(tuple(r) for r in runs.digests(docs).collect() if r["doc_id"] in ids)
    assert got == want
    assert sum(w[1] > 0 for w in want) > 5


def test_awkward_rows_and_the_operator_itself(spark):
    docs = awkward(spark)
    want = sorted((brute_row(d["doc_id"], d["text"]) for d in docs.collect() if len(d["text"] or "") < 5000), key=str)
    got = sorted((tuple(r) for r in runs.digests(docs).collect() if r["doc_id"] != 8), key=str)
    assert got == want
    assert runs.digests(nothing(spark)).collect() == []
    text = "start " + "again and " * 30 + "end"
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_words"] == 62 and [tuple(r) for r in row["runs"]] == [(1, 60, 2)] and row["collapsed"] == "start again and end"
