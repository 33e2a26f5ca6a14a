"""HyperLogLog sketches with 16 or 32 byte registers, kept as plain columns.

A sketch is a set of columns ``h0 .. h{m-1}``; building and merging are ``max``
aggregates, so both combine on the map side and no group has to be collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import bit_length, lng, with_hash32


@dataclass(frozen=True)
class SketchKind:
    registers: int
    index_bits: int
    alpha: float

    @property
    def rank_bits(self) -> int:
        return 32 - self.index_bits

    @property
    def columns(self) -> list[str]:
        return [f"h{i}" for i in range(self.registers)]


# Register counts and bias constants of the two sketches.
HLL16 = SketchKind(registers=16, index_bits=4, alpha=0.673)
HLL32 = SketchKind(registers=32, index_bits=5, alpha=0.697)
EMPTY_REMAINDER_RANK = 31


def with_rank(df: DataFrame, c: Column, kind: SketchKind) -> DataFrame:
    """Add ``register`` and ``rank`` of column index ``c``.

    The low hash bits name the register; the rank is the number of leading
    zeros of the rest, plus one.
    """
    rest = F.shiftrightunsigned(F.col("_h"), kind.index_bits)
    rank = F.when(F.col("_rest") == 0, EMPTY_REMAINDER_RANK).otherwise(
        F.lit(kind.rank_bits + 1) - bit_length(F.col("_rest")))
    return (
        with_hash32(df, c, "_h")
        .withColumn("register", F.col("_h").bitwiseAND(lng(kind.registers - 1)).cast("int"))
        .withColumn("_rest", rest)
        .withColumn("rank", rank.cast("int"))
        .drop("_h", "_rest")
    )


def build(kind: SketchKind) -> list[Column]:
    """Aggregates that turn (register, rank) rows into a sketch."""
    return [
        F.expr(f"coalesce(max(CASE WHEN register = {i} THEN rank END), 0) AS {name}")
        for i, name in enumerate(kind.columns)
    ]


def merge(kind: SketchKind) -> list[Column]:
    return [F.expr(f"max({name}) AS {name}") for name in kind.columns]


def estimate(upper: Column, kind: SketchKind) -> Column:
    """Distinct count of a sketch, clamped to [1, upper]; 0 when upper is 0.

    The raw estimate is alpha m^2 / sum 2^-rank; small ones with empty
    registers use linear counting. Halves round up.
    """
    m = kind.registers
    inverse = F.expr(" + ".join(f"pow(2.0D, -{h})" for h in kind.columns))
    zeros = F.expr(" + ".join(f"CAST({h} = 0 AS INT)" for h in kind.columns))
    raw = F.lit(kind.alpha * m * m) / inverse
    linear = F.lit(float(m)) * F.ln(F.lit(float(m)) / F.nullif(zeros, F.lit(0)))
    value = F.when((raw <= 2.5 * m) & (zeros > 0), linear).otherwise(raw)
    rounded = F.floor(value + 0.5).cast("long")
    return F.when(upper == 0, lng(0)).otherwise(F.greatest(lng(1), F.least(upper, rounded)))
