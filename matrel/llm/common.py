"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, every other character untouched.

    Pure ASCII text takes the fast built-in; any other goes through ``translate``.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower()))


def batches_of(batch, *names):
    """Python lists of the named columns of one Arrow batch."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


class Memo(dict):
    """Memo of a function of one key, in two generations of at most ``bound`` keys.

    ``trim`` retires the young generation when it is full, so the memory never grows with the
    data and frequent keys stay.
    """

    def __init__(self, function, bound: int = 400_000):
        super().__init__()
        self.function, self.bound, self.old = function, bound, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, hot: int = 1000) -> DataFrame:
    """Left join of ``groups`` (one row per key, null keys match nothing) that no hot key can slow down.

    Keys whose ``size`` is at least 1/hot of ``total`` rows are at most ``hot`` keys: they are
    broadcast, and their rows leave the shuffled join under keys of their own.
    """
    names, values = rows.columns, [c for c in groups.columns if c != key]
    groups = groups.select(F.col(key).alias("_key"), F.struct(*values).alias("_g"))
    is_hot = F.col(f"_g.{size}") * hot >= total
    large = groups.filter(is_hot).withColumnsRenamed({"_g": "_g1", "_key": "_k1"})
    rows = rows.join(F.broadcast(large), F.col(key) == F.col("_k1"), "left")
    done = F.col("_k1").isNotNull() | F.col(key).isNull()
    rows = rows.withColumn("_turn", F.when(done, F.monotonically_increasing_id()).otherwise(F.lit(-1)))
    small = groups.filter(~is_hot).select(F.col("_key").alias("_k2"), F.col("_g").alias("_g2"), F.lit(-1).cast("long").alias("_t2"))
    rows = rows.join(small, (F.col(key) == F.col("_k2")) & (F.col("_turn") == F.col("_t2")), "left")
    group = F.coalesce("_g1", "_g2")
    return rows.select(*names, *[group[v].alias(v) for v in values])


def text_key() -> Column:
    """Tells texts of rows with one doc_id apart."""
    return F.xxhash64(text_or_empty())


def without_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the lines at the listed places taken out; all columns stay, ``n_chars`` is counted anew.

    ``removed`` holds ``doc_id, text_key, places`` (zero-based line numbers), once per key. A text
    of no lines left is empty; a null text stays null.
    """
    removed = removed.select(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key"), F.col("places").alias("__llm_places"))
    names = docs.columns
    rows = docs.withColumn("__llm_own", text_key())
    rows = rows.join(removed, F.col("__llm_own").eqNullSafe(F.col("__llm_key")) & F.col("doc_id").eqNullSafe(F.col("__llm_id")), "left")
    lines = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains("__llm_places", i))
    rows = rows.withColumn("text", F.when(F.col("__llm_places").isNull(), F.col("text")).otherwise(F.concat_ws("\n", lines)))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.col("__llm_places").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return rows.select(*names)
