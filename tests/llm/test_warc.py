import gzip
import io

import duckdb
import pytest
from pyspark.sql import functions as F

from matrel.llm import warc
from tests.llm.helpers import SMALL

DATE = "2020-01-02T03:04:05Z"


def archive(*parts):
    return b"".join(warc.gzip_member(warc.record_bytes(*p)) for p in parts)


class Trickle(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, size=-1):
        return super().read(min(size, 7) if size >= 0 else 7)


RECORDS = [
    ("response", "urn:record:1", "http://a/é ü\r\nX: y", DATE, b"<html>" + b"x" * 200_000 + b"</html>"),
    ("revisit", "urn:record:2", "http://b/", DATE, b"<html>hello</html>", "urn:record:1"),
    ("response", "urn:record:3", None, DATE, b""),
    ("response", "urn:record:4", "http://c/", DATE, b"\r\n\r\nbody\r\n\r\n"),
]


@pytest.mark.parametrize("stream", [io.BytesIO, Trickle])
def test_records_are_read_back_in_order(stream):
    data = archive(*RECORDS)
    rows = list(warc.read_stream(stream(data), keep_payload=True))
    assert [r["problem"] for r in rows] == [None] * 4
    assert [r["kind"] for r in rows] == [p[0] for p in RECORDS]
    assert [r["payload_bytes"] for r in rows] == [len(p[4]) for p in RECORDS]
    assert rows[0]["payload"] == RECORDS[0][4] and rows[3]["payload"] == RECORDS[3][4] and rows[1]["payload"] is None
    assert "\n" not in rows[0]["uri"] and rows[1]["refers_to"] == "<urn:record:1>"
    # a member can be read from its offset alone
    for i, row in enumerate(rows):
        assert next(warc.read_stream(stream(data[row["offset"]:])))["record_id"] == f"<{RECORDS[i][1]}>"


def test_members_are_plain_gzip():
    text = gzip.decompress(archive(*RECORDS))
    assert text.count(b"WARC/1.1\r\n") == 4 and text.endswith(b"\r\n\r\n")


def test_damage_is_told_and_ends_the_file():
    data = archive(*RECORDS)
    assert [r["problem"] for r in warc.read_stream(io.BytesIO(data[:-5]))] == [None, None, None, "truncated member"]
    broken = bytearray(data)
    broken[-3] ^= 1                               # the stored length of the last member
    assert list(warc.read_stream(io.BytesIO(bytes(broken))))[-1]["problem"] == "damaged member"
    raw = warc.record_bytes(*RECORDS[3])
    for before, after, problem in (
            (b"Content-Length: 96", b"Content-Length: 95", "record longer than its length"),
            (b"Content-Length: 96", b"Content-Length: 999", "block shorter than its length"),
            (b"Content-Length: 96", b"Content-Length: x", "no Content-Length"),
            (b"WARC/1.1", b"WORC/1.1", "no WARC record"), (b"\r\nbody", b"\r\nBODY", "payload digest differs")):
        if before.startswith(b"Content-Length"):
            before = b"Content-Length: %d" % (len(raw) - raw.index(warc._END) - 8)
        assert before in raw
        rows = list(warc.read_stream(io.BytesIO(warc.gzip_member(raw.replace(before, after, 1)))))
        assert rows[-1]["problem"] == problem
    rows = list(warc.read_stream(io.BytesIO(warc.gzip_member(raw) + b"junk")))
    assert [r["problem"] for r in rows] == [None, "damaged member"]


def test_empty_archive():
    assert list(warc.read_stream(io.BytesIO(b""))) == []


def test_small_files_and_payloads_in_spark(spark, tmp_path):
    rows = [(i, f"http://x/{i}", bytes([i % 5]) * 3000 * i) for i in range(40)]
    kinds = warc.classified(spark.createDataFrame(rows, "record_id long, uri string, payload binary"))
    files = warc.write_archives(kinds, str(tmp_path / "out"), file_bytes=500)
    assert files.count() > 1 and files.agg(F.sum("records")).first()[0] == 40
    back = {r["record_id"]: r for r in warc.read_archives(files, keep_payload=True).collect()}
    for i, uri, payload in rows:
        r = back[f"<urn:record:{i}>"]
        assert r["problem"] is None and r["uri"] == uri and r["kind"] == "response" and r["payload"] == payload


def test_round_trip_against_sql(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    pages = pages.unionByName(pages.filter("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 1000)).unionByName(
        pages.limit(1).withColumn("html", F.lit(None).cast("string")))
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    want = sorted(con.execute(warc.SQL).fetchall(), key=str)
    assert got == want and any(r[3] == "revisit" for r in got)


def test_awkward_pages(spark):
    rows = [(1, None, None), (2, "http://a/\n", ""), (3, "u", "same"), (3, "v", "same"), (2, "w", "same"), (None, "x", "same"), (None, "y", "alone"),
            (None, "z", "alone"), (4, "big", "é" * 300_000)]
    pages = spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, kind string, same int")
    got = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == sorted([(1, 0, "revisit", 2), (2, 0, "response", None), (3, 4, "response", None), (3, 4, "response", None), (2, 4, "revisit", 3),
                          (-1, 4, "revisit", 3), (-1, 5, "response", None), (-1, 5, "response", None), (4, 600_000, "response", None)], key=lambda x: x[:3])
    assert warc.round_trip(pages.limit(0)).collect() == []
    least = {(r["page_id"], r["payload_bytes"]): r["record_type"] for r in warc.round_trip(pages, least=1).collect()}
    assert least[(1, 0)] == least[(2, 0)] == "response" and least[(2, 4)] == "revisit"
