"""Proportional stratified interleaving into shards of equal row counts.

Rows are shuffled inside their source by a seeded hash, ranked, and placed at the fractional
rank (rank - u) / size of the source, with a phase u between 0 and 1 of the source: without it
all sources of one row would stand at one half. Sorting all rows by that fraction, ties by the hash of the row, interleaves the
sources in proportion, so a cut of the order into equal runs gives every shard the mixture
of the whole table, each source to within about one row, and many small sources by their sum.

Ranks and places are counted without one task seeing a whole source: the hash (and then the
fraction) is cut into equal slices, counts of slices are summed up, and rows are numbered
inside their slice. Both the hash and the fraction spread evenly, so slices stay near
``SLICE_ROWS`` rows whatever the sizes of the sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrel.llm.common import text_or_empty
from matrel.session import stage

SEED = "interleave-1"
SLICE_ROWS = 2_000
SHARDS = 40
GOLDEN = (5**0.5 - 1) / 2


def _before(counts: DataFrame, keys: list[str], slice_: str) -> DataFrame:
    """Rows in earlier slices of the same key; slices are summed per block first, so one key's task holds few rows."""
    block = (F.col(slice_) / 4096).cast("long")
    counts = counts.withColumn("_block", block)
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("n").alias("bn"))
    over_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("b0", F.coalesce(F.sum("bn").over(over_blocks), F.lit(0))).drop("bn")
    inside = Window.partitionBy(*keys, "_block").orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("s0", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    same = F.col("x._block") == F.col("y._block")
    for key in keys:
        same = same & F.col(f"x.{key}").eqNullSafe(F.col(f"y.{key}"))
    return counts.alias("x").join(blocks.alias("y"), same).select(
        *[F.col(f"x.{k}") for k in keys], f"x.{slice_}", (F.col("s0") + F.col("b0")).alias("before"))


def _numbered(rows: DataFrame, keys: list[str], slice_: str, order: list[Column]) -> DataFrame:
    """Zero-based number of each row in the order (keys, slice_, order), as column ``at``."""
    offsets = _before(rows.groupBy(*keys, slice_).agg(F.count(F.lit(1)).alias("n")), keys, slice_)
    names = [*keys, slice_]
    offsets = offsets.select(*[F.col(n).alias(f"_{n}") for n in names], "before")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    window = Window.partitionBy(*names).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(window) - 1)
    return ranked.join(offsets, same).withColumn("at", F.col("before") + F.col("_r")).drop("_r", "before", *[f"_{n}" for n in names])


def interleave(docs: DataFrame, shards: int = SHARDS, by: str = "source", seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    The law is ``rows``: counts of shards differ by at most one, and ``grown_shard`` is null.
    Null sources form a source of their own; null texts have the size 16 and the checksum 0.
    Rows equal in every column used are interchangeable. An empty table gives an empty result.
    """
    text = text_or_empty()
    rows = docs.select(
        "doc_id", F.col(by).cast("string").alias("_src"), (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    # 52 bits of a seeded digest, exact as a double; equal or null doc_ids are told apart by their texts
    named = lambda *parts: F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    bits = lambda digest: F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    rows = stage(rows.withColumn("h", bits(named(F.col("doc_id"), F.col("text_crc32"), F.col("size")))))
    total = rows.count()
    slices = max(1, -(-total // slice_rows))
    sizes = rows.groupBy("_src").agg(F.count(F.lit(1)).alias("_size"))
    # slices in proportion to the source: its rows spread evenly over them
    sizes = sizes.withColumn("_cut", F.greatest(F.lit(1), F.ceil(F.col("_size") / slice_rows)))
    # phases of a golden-ratio sequence over the sources in the order of their hashes: any stretch of them is spread evenly
    sizes = stage(sizes.withColumn("_hash", bits(named(F.lit("source"), F.col("_src")))))
    source_slices = max(1, -(-sizes.count() // slice_rows))
    sizes = sizes.withColumn("_slice", F.floor(F.col("_hash") / F.lit(2.0**52) * source_slices).cast("long"))
    golden = (F.col("at") + 0.5) * F.lit(GOLDEN)
    sizes = stage(_numbered(sizes, [], "_slice", [F.col("_hash"), F.col("_src")]).withColumn("_phase", golden - F.floor(golden)))
    rows = rows.alias("r").join(sizes.alias("s"), F.col("r._src").eqNullSafe(F.col("s._src"))).select("r.*", "_size", "_cut", "_phase")
    rows = rows.withColumn("_slice", F.floor(F.col("h") / F.lit(2.0**52) * F.col("_cut")).cast("long"))
    ranked = _numbered(rows, ["_src"], "_slice", [F.col("h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    ranked = ranked.withColumn("f", (F.col("at") + F.col("_phase")) / F.col("_size")).drop("at")
    ranked = stage(ranked.withColumn("_part", F.floor(F.col("f") * slices).cast("long")))
    placed = _numbered(ranked, [], "_part", [F.col(c) for c in ("f", "h", "doc_id", "text_crc32", "size", "_src")])
    placed = placed.withColumn("shard", F.expr(f"(at * {shards}L) div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_src").alias(by))
