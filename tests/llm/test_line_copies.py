"""The pipeline and op8 keep repeated lines in proven copies only."""

import random

import corpus_pipeline
from matrel.llm import line_dedup


def test_only_proven_copies_keep_repeated_lines(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(10))
    a, b, c = ([line() for _ in range(10)] for _ in range(3))
    own, loop = [line() for _ in range(4)], line()
    rows = [
        (0, a), (1, b), (2, a[:6] + own),              # shares 6 of 10 lines: no copy
        (3, a[:5] + b[:5]),                            # put together from two documents
        (4, [loop] * 8 + c[:3]),                       # repeats a line of its own
        (5, a + ["short"]),                            # a copy of 0
        (6, a + b[:4]),                                # 0 with passages of 1: a copy of 0 once they are out
        (7, b + [b[2]]), (7, b + [b[2]]),              # a copy of 1 with a line of its own twice, as repeated rows
        (8, c), (None, c)]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string").coalesce(1)
    got = {}
    for r in corpus_pipeline.repeated_lines(spark, docs, "").collect():
        assert got.setdefault(r["doc_id"], r["text"].split("\n")) == r["text"].split("\n")
    assert got == {0: a, 1: b, 2: own, 3: [""], 4: [loop] + c[:3], 5: a + ["short"], 6: a, 7: b, 8: c[3:], None: c[3:]}
    verdicts = line_dedup.repeated_lines(docs, copy_share=None)
    assert verdicts.count() == len(rows)
    assert {r["doc_id"] for r in verdicts.filter("whole").collect()} == {5, 6, 7, None}


def test_word_hashes_of_a_task_stay_few():
    from matrel.llm.near_dedup import WORD_HASHES, Shingler

    shingler = Shingler()
    for begin in range(0, 400_000, 1000):
        shingler(" ".join(f"word{i}" for i in range(begin, begin + 1000)).encode())
    assert len(shingler.memo) + len(shingler.memo.old) <= 2 * (WORD_HASHES + 1000) < 140_000
    assert (shingler(b"a b c d e f") == Shingler()(b"a b c d e f")).all()


def test_a_line_makes_one_row_for_each_lookup(spark):
    lines = ["the quick brown fox jumps over", "a line of other words and Ω \U0001F600", "ab" * 40]
    docs = spark.createDataFrame([("\n".join(lines),), (lines[0],)], "text string").coalesce(1)
    rows = line_dedup._segment_rows(docs, 2, 20).collect()
    assert len(rows) == sum(len(line_dedup.probes(len(x), 2)) for x in lines)          # index entries are lookups as well
    assert sum(r["entry"] for r in rows) == 3 * len(lines)


def test_keys_are_those_of_the_substrings():
    rng = random.Random(3)
    lines = ["".join(rng.choice("ab ￿\xe9\U0001F600") for _ in range(rng.randint(3, 60))) for _ in range(300)]
    segmenter = line_dedup.Segmenter(2)
    keys, entries, counts = segmenter(lines)
    plain = [(n, i, x[at:at + size]) for x in lines for n, i, at, size in line_dedup.probes(len(x), 2)]
    own = [at == line_dedup.segments(len(x), 2)[i][0] and n == len(x) for x in lines for n, i, at, _ in line_dedup.probes(len(x), 2)]
    assert sum(counts) == len(keys) == len(plain) and list(entries) == own
    assert len(set(zip(plain, keys.tolist()))) == len(set(plain)) == len(set(keys.tolist()))
    long = ["x" * 40, "ab￿" * (line_dedup.TEXT_BLOCK // 2)]
    assert (segmenter(long)[0][len(line_dedup.probes(40, 2)):] == segmenter(long[1:])[0]).all()


def test_links_of_lines_in_and_beyond_latin_1(spark):
    base = ["функция number one of many lines", "caf\xe9 au lait and a croissant please", "plain letters that make up a line"]
    texts = base + [base[0][1:], base[1].replace("caf\xe9", "cafē"), base[2] + "\U0001F600!"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string")
    ids = {line_dedup.xxhash.xxh3_64_intdigest(x.encode()): i for i, x in enumerate(texts)}
    got = {frozenset((ids[r["a"] % 2**64], ids[r["b"] % 2**64])) for r in line_dedup.line_links(docs).collect()}
    assert got == {frozenset((i, i + 3)) for i in range(3)}


def test_live_keys_in_tasks_and_by_a_shuffle_give_the_same_links(spark, monkeypatch):
    rng = random.Random(8)
    lines = [" ".join(f"w{rng.randint(0, 99)}" for _ in range(8)) for _ in range(60)]
    docs = spark.createDataFrame([("\n".join(lines[:40]),), ("\n".join(x[:-1] + "y" for x in lines[20:]),), (None,)], "text string").repartition(3)
    pairs = lambda: sorted(map(tuple, line_dedup.line_links(docs).collect()))
    scans, plain = [], line_dedup._line_texts
    monkeypatch.setattr(line_dedup, "_line_texts", lambda *x: scans.append(1) or plain(*x))
    few = pairs()
    assert len(few) >= 20 and not scans              # the texts came with the keys, without a scan of their own
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    assert pairs() == few and scans
    assert line_dedup.line_links(docs.filter("text IS NULL")).count() == 0


def test_keys_that_meet_in_a_bucket():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(9)
    rows = [(rng.randrange(40) << 1, rng.randrange(6), rng.random() < 0.3) for _ in range(120)]
    want = set()
    for key in {k for k, _, _ in rows}:
        own = [x for x in rows if x[0] == key]
        if len({i for _, i, _ in own}) > 1 and any(e for _, _, e in own):
            want |= {(key >> 1, i, any(e for _, j, e in own if i == j)) for _, i, _ in own}
    lists = [rows[i:i + 7] for i in range(0, len(rows), 7)]
    packed = lambda values: np.array(values, np.uint64).tobytes()
    table = pa.table({"keys": pa.array([packed([k | e for k, _, e in x]) for x in lists], pa.binary()),
                      "ids": pa.array([packed([i for _, i, _ in x]) for x in lists], pa.binary())})
    got = [tuple(x.values()) for x in line_dedup._met(table).to_pylist()]
    assert set(got) == want and len(got) == len(want) > 10 and line_dedup._met(table.slice(0, 0)).num_rows == 0
