"""MinHash near-dedup with circulant signatures.

Two permutations of the 32-bit hash values make all coordinates: the first is applied once, and
coordinate k is the least value of the second one, shifted circularly by k. ``BANDS`` bands of
``ROWS`` coordinates give the buckets; a pair at the similarity limit shares none with a
probability of (1 - 0.75 ** 5) ** 40 = 2e-5.

Documents with equal shingle sets are one vertex from the start, so copies never meet in a
bucket. Within a bucket the members are first compared with its smallest one alone, then, where
they are still in different components, with its most central one: the one with the smallest
share of shingles that no other such document has. What is left is compared inside a join, unless
the members are in one component (a link inside it cannot change the result) or the numbers of
their shared shingles rule a link out: shingles held by one document alone are in no
intersection. No pair that could change the result is left out, and every link is confirmed on
the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import Memo, attach, text_or_empty
from matrel.llm.components import components
from matrel.session import scratch, stage

WORDS = 5
SIMILAR = 75            # percent
ROWS, BANDS = 5, 40
BLOCK = 2048            # shingles whose coordinates are computed together
WORD_HASHES = 1 << 16   # word hashes kept, in each of two generations: what a task holds besides its rows


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _permute32(x: np.ndarray, first: int, second: int) -> np.ndarray:
    """A bijection of 32-bit values, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(first)
    x ^= x >> np.uint32(13)
    x *= np.uint32(second)
    x ^= x >> np.uint32(16)
    return x


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text (UTF-8 bytes)."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.memo = Memo(xxhash.xxh3_64_intdigest, WORD_HASHES)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()          # bytes: A-Z and ASCII white space only
        if not words:
            return np.empty(0, np.uint64)
        hashes = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        self.memo.trim()
        width = min(self.words, len(words))
        count = len(words) - width + 1
        out = mix64(hashes[:count] + np.uint64(width))
        for k in range(1, width):
            out = mix64(out + hashes[k:k + count])
        return np.unique(out)


def signature(shingles: np.ndarray, rows: int = ROWS, bands: int = BANDS) -> np.ndarray:
    """Bucket of each band, as signed 64-bit values."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    first = _permute32(folded ^ np.uint32(0x9E3779B9), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(rows * bands, dtype=np.uint32)[:, None]
    least = np.full(rows * bands, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(first), BLOCK):
        values = _permute32(first[None, at:at + BLOCK] - shifts, 0x85EBCA6B, 0xC2B2AE35)
        np.minimum(least, values.min(axis=1), out=least)
    cells = least.reshape(bands, rows).astype(np.uint64)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        out = mix64(out + cells[:, r])
    return out.view(np.int64)


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(1).cast(pa.binary()).to_pylist()


def list_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _signatures(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                sizes, digests, buckets = [], [], []
                for text in _texts(batch):
                    s = shingler(text)
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    buckets.append(signature(s) if len(s) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), list_array(buckets)],
                    names=["doc_id", "n_shingles", "digest", "buckets"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, buckets array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            for begin in range(0, whole.num_rows, 512):
                batch = whole.slice(begin, 512)
                sets = [shingler(text) for text in _texts(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(sets)], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= similar * union of their full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    close = F.least(na, nb) * 100 >= F.greatest(na, nb) * similar
    rows = pairs.join(right, "b").join(left, "a").filter(close)
    rows = rows.withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return rows.filter(F.col("common") * 100 >= (na + nb - F.col("common")) * similar).select("a", "b")


_MEMBER = ["node", "component", "size", "shared"]


def _unsettled(hits: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    mixed = hits.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    return hits.join(mixed, "bucket", "left_semi")


def _shared_sizes(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node, size, shared`` of the nodes: shingles, and those that another of the nodes has too."""
    rows = sets.join(nodes, "node", "left_semi")
    alone = rows.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.min("node").alias("node")).filter("n = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    return rows.join(alone, "node", "left").select(
        "node", F.size("shingles").alias("size"), (F.size("shingles") - F.coalesce("alone", F.lit(0))).cast("int").alias("shared"))


def _possible(similar: int) -> Column:
    """Whether two members can be linked by their sizes and shared sizes."""
    common = F.least("shared", "shared_2")
    return common * 100 >= (F.col("size") + F.col("size_2") - common) * similar


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("node").alias("a"), F.col("node_2").alias("b"), F.col("component").alias("ca"), F.col("component_2").alias("cb"))


def _able(rows: DataFrame, similar: int) -> tuple[DataFrame, Column]:
    """Rows of another member of the bucket beside those of each, and whether the two can be linked: for one bucket that both share."""
    others = rows.select(*[F.col(c).alias(f"{c}_2") for c in rows.columns])
    once = F.array_min(F.array_intersect("all", "all_2")) == F.col("bucket")
    return others, (F.col("bucket") == F.col("bucket_2")) & (F.col("component") != F.col("component_2")) & _possible(similar) & once


def _late_links(hits: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """All links between members of one bucket in different components, found inside the join.

    The pairs are not written out: sizes, the first bucket that both members share, and the full
    sets are conditions of the join, so a row comes out for a link only. Sets are joined only to
    members that some other member of the bucket can be linked with by all but the sets.
    """
    own = hits.groupBy("node").agg(F.collect_set("bucket").alias("all"))
    light = hits.select("bucket", *_MEMBER).join(own, "node")
    others, able = _able(light, similar)
    rows = stage(stage(light.join(others, able, "left_semi")).join(sets, "node"))
    others, able = _able(rows, similar)
    common = F.size(F.array_intersect("shingles", "shingles_2"))
    linked = common * 100 >= (F.col("size") + F.col("size_2") - common) * similar
    return _ends(rows.join(others, able & (F.col("component") < F.col("component_2")) & linked))


def _merged(labels: DataFrame, hits: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels and hits after the links (a, b) of components (ca, cb) have joined them."""
    moved = stage(components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(
        F.col("node").alias("component"), F.col("component").alias("to")))
    own = moved.select(F.col("component").alias("node"), "component")     # the least node of a component has no label yet
    labels = labels.unionByName(own.join(labels, "node", "left_anti")).join(moved, "component", "left")
    labels = stage(labels.select("node", F.coalesce("to", "component").alias("component")))
    hits = hits.join(moved, "component", "left").withColumn("component", F.coalesce("to", "component")).drop("to")
    return labels, hits


def _labelled(docs: DataFrame, words: int, similar: int, keep) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_shingles, digest, buckets`` of each row, and ``digest, copies, component_id`` of each set; both are kept."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = keep(stage(_signatures(texts, words)))
    known = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    vertices = stage(known.groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.any_value("buckets").alias("buckets")))
    rows = vertices.select("node", F.explode("buckets").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("node").alias("lead"), F.max("node").alias("last")).filter("lead < last").drop("last")
    hits = stage(rows.join(shared, "bucket"))
    wanted = hits.select(F.col("node").alias("doc_id")).distinct()
    sets = stage(_sets(texts.join(wanted, "doc_id", "left_semi"), words))

    star = hits.filter("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    labels = stage(components(confirmed(star, sets, similar)))
    hits = stage(_unsettled(hits.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))))
    hits = stage(hits.join(_shared_sizes(sets, hits.select("node").distinct()), "node"))
    possible = _possible(similar)
    central = hits.groupBy("bucket").agg(F.max(F.struct(F.col("shared") / F.col("size"), F.struct("node", "component", "size", "shared").alias("m")))["m"].alias("m"))
    central = central.select("bucket", *[F.col(f"m.{c}").alias(f"{c}_2") for c in _MEMBER])
    pairs = hits.join(central, "bucket").filter((F.col("component") != F.col("component_2")) & possible)
    pairs = stage(_ends(pairs).distinct())
    found = confirmed(pairs.select("a", "b"), sets, similar).distinct().join(pairs, ["a", "b"])
    labels, hits = _merged(labels, hits, found)
    late = stage(_late_links(stage(_unsettled(hits)), sets, similar))
    labels, _ = _merged(labels, hits, late)
    labels = vertices.select("digest", "node", "copies").join(labels, "node", "left").select(
        "digest", "copies", F.coalesce("component", "node").alias("component_id"))
    return signed, keep(stage(labels))


def near_duplicates(docs: DataFrame, words: int = WORDS, similar: int = SIMILAR) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Words are runs of characters other than ASCII white space, with A-Z lowered. A document of
    fewer words than a shingle is one shingle; one without words (or with a null text) has none
    and is linked with nothing. ``component_id`` is the smallest doc_id reachable over links.
    Rows that share a doc_id are one vertex. A row with a null doc_id is not linked: its
    component is null and it is kept. Other columns are ignored; an empty table gives an empty
    result.
    """
    with scratch(docs.sparkSession) as keep:
        signed, labels = _labelled(docs, words, similar, keep)
    total = signed.count()
    out = attach(signed.drop("buckets").withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))), labels, "digest", "copies", total)
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: the smallest doc_id of each component.

    A document is a doc_id with a text. Rows that repeat both are one document and one of them
    stays; different texts under one doc_id, or under none, are documents of their own (the
    least by doc_id, nulls last, then by text hash stays of a group). Only tables with such rows
    are numbered anew, which shuffles their rows twice.
    """
    text = text_or_empty()
    key = [F.col("doc_id").alias("__llm_id"), F.xxhash64(text).alias("__llm_k1"), F.xxhash64(F.lit(1), text).alias("__llm_k2")]
    keys = stage(docs.select(*key))
    if keys.filter("__llm_id IS NULL").isEmpty() and keys.groupBy("__llm_id").count().filter("count > 1").isEmpty():
        with scratch(docs.sparkSession) as keep:
            gone = keep(stage(near_duplicates(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("__llm_gone")).distinct()))
        return docs.join(gone, F.col("doc_id") == F.col("__llm_gone"), "left_anti")
    # ids that grow with the partition and the row keep the order of the sort
    ordered = keys.distinct().orderBy(F.col("__llm_id").asc_nulls_last(), "__llm_k1", "__llm_k2")
    nodes = stage(ordered.withColumn("__llm_node", F.monotonically_increasing_id()))
    names = docs.columns
    first = docs.groupBy(*key).agg(F.first(F.struct(*[F.col(f"`{n}`") for n in names])).alias("__llm_row"))      # repeated rows are combined before the shuffle
    rows = first.withColumnsRenamed({n: f"{n}_1" for n in ("__llm_id", "__llm_k1", "__llm_k2")})
    rows = rows.join(nodes, F.col("__llm_id_1").eqNullSafe(F.col("__llm_id")) & F.col("__llm_k1_1").eqNullSafe(F.col("__llm_k1"))
                     & F.col("__llm_k2_1").eqNullSafe(F.col("__llm_k2")))
    rows = stage(rows.select("__llm_node", "__llm_row"))
    found = near_duplicates(rows.select(F.col("__llm_node").alias("doc_id"), F.col("__llm_row")["text"].alias("text")))
    kept = found.filter("kept").select(F.col("doc_id").alias("__llm_kept"))
    return rows.join(kept, F.col("__llm_node") == F.col("__llm_kept"), "left_semi").select(*[F.col("__llm_row")[n].alias(n) for n in names])


SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                     ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT both_.b, reach.c FROM reach JOIN both_ ON both_.a = reach.doc_id)
SELECT reach.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, reach.doc_id = min(c) AS kept
FROM reach LEFT JOIN n ON reach.doc_id = n.doc_id GROUP BY reach.doc_id
"""
