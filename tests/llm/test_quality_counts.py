"""Boilerplate against a brute-force count of documents, with short pages and a large group of near copies."""

import random
from collections import defaultdict

from matrel.llm import quality

from .helpers import near_components

SHARE, LEAST = 0.02, 8


def brute_removed(rows):
    lines = lambda t: [" ".join(x.split()) for x in t.lower().split("\n")]
    classes = {i: c for i, (_, c) in near_components({i: t for i, _, t in rows}).items()}
    held, hosts = defaultdict(set), defaultdict(set)
    for i, source, text in rows:
        hosts[source].add(classes[i])
        for line in set(lines(text)) - {""}:
            held[source, line].add(classes[i])
    return {i: [k for k, line in enumerate(lines(text)) if line and len(held[source, line]) > max(LEAST, SHARE * len(hosts[source]))]
            for i, source, text in rows}


def test_notice_of_short_pages_and_near_copies(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    rows = []
    for h in range(12):                    # whichever line has the least hash, some notice of these has it in most pages
        notice = [f"notice {h} line {k} of the host" for k in range(6)]
        for i in range(60):
            rows.append((len(rows), f"h{h}", "\n".join([prose(12) for _ in range(2)] + notice * (i % 3 == 0))))
    text = [prose(15) for _ in range(8)]
    for i in range(60):                    # near copies with the edit in a line of its own each time: one document of the host
        copy = list(text)
        copy[i % 8] += f" x{i}"
        rows.append((len(rows), "copies", "\n".join(copy)))
    rows += [(len(rows) + i, "copies", prose(90)) for i in range(40)]
    got = {r["doc_id"]: sorted(r["places"] or []) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    want = brute_removed(rows)
    assert got == want
    assert all(want[60 * h] for h in range(12)) and not any(want[i] for i in range(720, 820))


def test_exact_copies_and_total_of_a_host(spark, monkeypatch):
    """A host has as documents its different texts, near copies joined only among those that hold a candidate line."""
    rng = random.Random(4)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    page = "\n".join(prose(14) for _ in range(5))
    rows = [(i, "a", page) for i in range(500)]                                # exact copies: one document
    rows += [(500 + i, "a", f"{prose(40)}\nthe notice of this host is here") for i in range(12)]
    rows += [(600 + i, "a", prose(60)) for i in range(400)]
    rows += [(2000 + i, "b", page + f" {i}") for i in range(30)]               # near copies in another host
    staged = []
    plain = quality.near_duplicates
    monkeypatch.setattr(quality, "near_duplicates", lambda texts: staged.append(texts.count()) or plain(texts))
    got = {r["doc_id"]: sorted(r["places"] or []) for r in quality.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    # 12 notices among 1 + 12 + 400 documents: more than 2 % and more than 8
    assert {i for i, places in got.items() if places} == set(range(500, 512)) and got[505] == [1]
    # the 500 copies hold no candidate line; near copies and notices are compared, once per text
    assert staged == [12 + 30]
    # with 700 pages more the notice is below the share
    more = rows + [(5000 + i, "a", prose(60)) for i in range(700)]
    assert not any(r["places"] for r in quality.judge(spark.createDataFrame(more, "doc_id long, source string, text string")).collect())
