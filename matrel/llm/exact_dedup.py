"""Exact dedup by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after lower-casing A-Z. Copies combine in three steps,
each of which compares the digest *and* the whole text:

1. locally, by the map-side half of the salted aggregation (all rows of a task share one salt);
2. per (digest, text, salt), so a text that fills a third of the table spreads over ``SALTS`` tasks;
3. per (digest, text), over at most ``SALTS`` winners of each text.

Only groups of two or more are staged. They return to the documents in two joins: groups that
hold at least 1/HOT of all rows are broadcast (there are at most HOT of them), and the others
are joined by digest, where no key holds more than 1/HOT of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import lower_ascii, text_or_empty
from matrel.session import stage

SALTS = 16
HOT = 1000          # a group of at least 1/HOT of all rows is hot: never more than HOT groups


def _digests(docs: DataFrame) -> DataFrame:
    text = lower_ascii(text_or_empty())
    return docs.select(F.col("doc_id"), text.alias("t")).withColumn("digest", F.unhex(F.sha2("t", 256)))


def copy_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Texts held by two or more rows: ``digest, t, keep_id, group_size``."""
    salted = _digests(docs).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    local = salted.groupBy("digest", "t", "salt").agg(F.max("doc_id").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = local.groupBy("digest", "t").agg(F.max("m").alias("keep_id"), F.sum("n").alias("group_size"))
    return whole.filter("group_size > 1")


def exact_dedup(docs: DataFrame, salts: int = SALTS, hot: int = HOT) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text counts as empty, so null and empty texts form one group. Of equal texts the row
    with the largest doc_id stays; rows that repeat a doc_id and text all carry the same
    keep_id and are all marked kept when that id stays. A null doc_id never wins over another
    one; a group of null ids only has a null keep_id and ``kept`` true. An empty table gives an
    empty result. Columns other than doc_id and text are ignored.
    """
    groups = stage(copy_groups(docs, salts))
    rows = _digests(docs)
    # different texts under one digest are told apart by the text itself
    clash = groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    if clash.limit(1).count():
        keys, joined = ["digest", "t"], groups
    else:
        keys, joined = ["digest"], groups.drop("t")
        rows = rows.drop("t")
    joined = joined.select(*keys, F.struct("keep_id", "group_size").alias("g"))
    is_hot = F.col("g.group_size") * hot >= total
    large = joined.filter(is_hot).withColumnRenamed("g", "g1")
    rows = rows.join(F.broadcast(large), keys, "left")
    # rows of hot groups leave the shuffled join under a key of their own
    own = F.when(F.col("g1").isNull(), F.col("digest")).otherwise(
        F.unhex(F.sha2(F.concat_ws(":", F.lit("hot"), F.col("doc_id").cast("string")), 224)))
    small = joined.filter(~is_hot).withColumnRenamed("digest", "own").withColumnRenamed("g", "g2")
    rows = rows.withColumn("own", own).join(small, ["own", *keys[1:]], "left")
    group = F.coalesce("g1", "g2")
    size = F.coalesce(group["group_size"], F.lit(1).cast("long"))
    keep = F.when(group.isNull(), F.col("doc_id")).otherwise(group["keep_id"])
    return rows.select(
        "doc_id", keep.alias("keep_id"), size.alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; one row of each repeated (doc_id, text)."""
    kept = exact_dedup(docs).filter("kept").select(F.col("doc_id").alias("__llm_id"), F.col("text_sha256").alias("__llm_d")).distinct()
    digest = F.sha2(lower_ascii(text_or_empty()), 256)
    rows = docs.withColumn("__llm_digest", digest).dropDuplicates(["doc_id", "__llm_digest"])
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("__llm_id")) & (F.col("__llm_digest") == F.col("__llm_d")), "left_semi").drop("__llm_digest")


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g ON d.t = g.t
"""
