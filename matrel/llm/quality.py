"""Quality rules: base statistics of a text and cross-document line frequency.

Lines are normalised (A-Z lowered, white space collapsed) and hashed. For each host, the column
``source``, the documents that hold a line are counted; equal texts of a host are one document.
A line held by more than ``LINE_SHARE`` of the documents of its host, and by more than
``LINE_LEAST``, is boilerplate and taken out, and copies are no reason to take lines out: near
copies too count once. They are looked for where they can matter: only among the documents with a line that
passes the limits by the plain counts, as a line that fails them fails them with fewer documents as
well. Of these documents, one near-dedup class, its links confirmed on full shingle sets, is one
document of its host, for the lines and for the total; all others count as they are. A document that keeps less than
``KEEP_SHARE`` of its words is depleted and rejected, as is one that fails the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import attach, text_key, without_lines
from matrel.llm.near_dedup import near_duplicates
from matrel.session import scratch, stage

LINE_SHARE = 0.02
LINE_LEAST = 8
KEEP_SHARE = 0.5
MIN_WORDS = 50
BROADCAST_KEYS = 1_000_000      # 8-byte keys sent to all tasks; more are joined by a shuffle of the texts
WHITE = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: list) -> int:
    """Words inside three-word windows that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, n)
    pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    _, window, count = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = count[window] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= again
    return int(covered.sum())


def text_statistics(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, repeated words."""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(WHITE)]
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def _profile(docs: DataFrame) -> DataFrame:
    """Statistics of each document and its lines, as ``lines (place, hash, words)``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                stats = []
                places, hashes, counts, ends = [], [], [], [0]
                for text in batch.column(3).to_pylist():
                    text = text or ""
                    stats.append(text_statistics(text))
                    for place, line in enumerate(text.encode().lower().split(b"\n")):
                        words = line.split()
                        if words:
                            places.append(place)
                            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                            counts.append(len(words))
                    ends.append(len(hashes))
                lines = pa.StructArray.from_arrays(
                    [pa.array(places, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(counts, pa.int64())],
                    names=["place", "hash", "words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2)] + [pa.array([s[i] for s in stats], pa.int64()) for i in range(5)]
                    + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)],
                    names=["doc_id", "host", "text_key", *names, "lines"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("host"), text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, host string, text_key long, " + ", ".join(f"{n} long" for n in names)
                           + ", lines array<struct<place: int, hash: bigint, words: bigint>>")


def _classes(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``text_key, family`` of the listed texts: the near-dedup class of each, from one row per text."""
    texts = docs.select(text_key().alias("doc_id"), F.col("text").cast("string").alias("text"))
    wanted = stage(keys.select(F.col("text_key").alias("doc_id")).distinct())
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    texts = stage(texts.join(wanted, "doc_id", "left_semi").groupBy("doc_id").agg(F.any_value("text").alias("text")))
    return near_duplicates(texts).select(F.col("doc_id").alias("text_key"), F.col("component_id").alias("family"))


def _passing(lines: DataFrame, counts: DataFrame, texts: DataFrame, total: int, line_share: float, line_least: int) -> tuple[DataFrame, DataFrame]:
    """Lines that may be boilerplate by plain counts, and ``host, text_key, n`` of the texts that hold one.

    The documents of a host are at least the texts that hold no line above ``line_least``; a line
    below the share of these is below that of all, whatever the near copies are.
    """
    marked = attach(lines, counts.drop("host"), "line", "n", total).filter("documents IS NOT NULL")
    holders = marked.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("holders"))
    least = texts.join(holders.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")), "left").select(
        F.col("host").alias("_host"), (F.col("texts") - F.coalesce("holders", F.lit(0))).alias("outside"))
    counts = counts.join(least, F.col("host").eqNullSafe(F.col("_host"))).filter(F.col("documents") > F.col("outside") * line_share)
    counts = stage(counts.select("host", "line", "n", "documents"))
    marked = attach(lines, counts.drop("host"), "line", "n", total).filter("documents IS NOT NULL")
    return counts, stage(marked.groupBy("host", "text_key").agg(F.collect_set("line").alias("held"), F.count(F.lit(1)).alias("n")))


def _rules(docs: DataFrame, line_share: float, line_least: int) -> tuple[DataFrame, DataFrame]:
    """Profiles with a row number, and per row the boilerplate: ``row, places, gone``."""
    with scratch(docs.sparkSession) as keep:
        rows = keep(stage(_profile(docs).withColumn("row", F.monotonically_increasing_id())))
        total = rows.count()
        lines = rows.select("row", "host", "text_key", F.explode("lines").alias("line")).select(
            "row", "host", "text_key", "line.place", "line.words", F.xxhash64(F.col("host").isNull(), "host", "line.hash").alias("line"))
        texts = stage(rows.select("host", "text_key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("texts")))
        held = lines.groupBy("host", "line", "text_key").agg(F.count(F.lit(1)).alias("n"))
        counts = stage(held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("n")).filter(F.col("documents") > line_least))
        counts, holders = _passing(lines, counts, texts, total, line_share, line_least)
        # near copies among the texts that hold such lines; a text may lie in several hosts
        families = stage(holders.join(_classes(docs, holders), "text_key").select("host", "family", "held"))
        inside = families.groupBy("host").agg(F.count(F.lit(1)).alias("inside"), F.count_distinct("family").alias("families"))
        hosts = texts.join(inside.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")), "left").select(
            F.col("host").alias("_host"), (F.col("texts") - F.coalesce("inside", F.lit(0)) + F.coalesce("families", F.lit(0))).alias("total"))
        documents = families.select("family", F.explode("held").alias("line")).distinct().groupBy("line").agg(F.count(F.lit(1)).alias("documents"))
        frequent = counts.drop("documents").join(documents, "line").join(hosts, F.col("host").eqNullSafe(F.col("_host")))
        frequent = frequent.filter((F.col("documents") > line_least) & (F.col("documents") > F.col("total") * line_share))
        frequent = keep(stage(frequent.select("line", "n", "documents")))
    marked = attach(lines, frequent, "line", "n", total).filter("documents IS NOT NULL")
    gone = marked.groupBy("row").agg(F.collect_list("place").alias("places"), F.sum("words").alias("gone"))
    return rows, gone


def judge(docs: DataFrame, line_share: float = LINE_SHARE, line_least: int = LINE_LEAST, keep_share: float = KEEP_SHARE) -> DataFrame:
    """One row per document: ``doc_id``, the base statistics, ``base_failed, kept, removed_words``, ``places`` and ``text_key``.

    Null text has no words and fails the base rules; null hosts are one host. Repeated rows are
    judged one by one and count as one document of their host. Other columns are ignored; an
    empty table gives an empty result. ``places`` are the numbers of the boilerplate lines.
    """
    rows, gone = _rules(docs, line_share, line_least)
    rows = rows.drop("lines", "host").join(gone, "row", "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    removed = F.coalesce("gone", F.lit(0).cast("long"))
    depleted = F.col("n_words") - removed < F.col("n_words") * keep_share
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & ~depleted).alias("kept"), removed.alias("removed_words"), "places", "text_key")


def judged(docs: DataFrame) -> DataFrame:
    """The verdicts without the line numbers."""
    return judge(docs).drop("places", "text_key")


def clean(docs: DataFrame) -> DataFrame:
    """The documents kept, without their boilerplate lines, with all columns of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        verdicts = keep(stage(judge(docs).select("doc_id", "text_key", "kept", "places").dropDuplicates(["doc_id", "text_key"])))
    gone = verdicts.filter(~F.col("kept")).select(F.col("doc_id").alias("__llm_gone_id"), F.col("text_key").alias("__llm_gone_key"))
    same = text_key().eqNullSafe(F.col("__llm_gone_key")) & F.col("doc_id").eqNullSafe(F.col("__llm_gone_id"))
    kept = docs.join(gone, same, "left_anti")
    return without_lines(kept, verdicts.filter("kept AND places IS NOT NULL"))
