"""Bit-level column expressions. Inputs are non-negative LONG columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Multipliers and offset of the 32-bit column hash.
HASH_OFFSET = 0x9E3779B9
HASH_MULTIPLIERS = (0x85EBCA6B, 0xC2B2AE35)

MASK32 = 0xFFFFFFFF


def lng(value: int) -> Column:
    return F.lit(value).cast("long")


def times32(x: Column, factor: int) -> Column:
    """x * factor mod 2^32 without leaving the LONG range (ANSI mode throws)."""
    low = x.bitwiseAND(lng(0xFFFF)) * lng(factor)
    high = (F.shiftrightunsigned(x, 16) * lng(factor)).bitwiseAND(lng(0xFFFF))
    return (low + high * lng(0x10000)).bitwiseAND(lng(MASK32))


def with_hash32(df: DataFrame, source: Column, name: str) -> DataFrame:
    """Add the 32-bit hash of ``source``: add the offset, then xor-shift and multiply twice.

    Every step reads the previous one twice, so the steps are separate
    projections; one nested expression would grow exponentially.
    """
    h = F.col(name)
    folded = lambda shift: h.bitwiseXOR(F.shiftrightunsigned(h, shift))
    df = df.withColumn(name, (source + lng(HASH_OFFSET)).bitwiseAND(lng(MASK32)))
    for shift, factor in zip((16, 13), HASH_MULTIPLIERS):
        df = df.withColumn(name, folded(shift)).withColumn(name, times32(h, factor))
    return df.withColumn(name, folded(16))


def bit_length(x: Column) -> Column:
    """Position of the highest set bit plus one; 0 for 0. Exact below 2^45.

    The half keeps the logarithm clear of the powers of two.
    """
    return (F.floor(F.log2(x + F.lit(0.5))) + 1).cast("int")


def floor_log2(x: Column) -> Column:
    return bit_length(F.greatest(x, lng(1))) - 1


def int_div(x: Column, divisor: Column | int) -> Column:
    """Integer division that stays in LONG arithmetic."""
    return F.call_function("div", x, lng(divisor) if isinstance(divisor, int) else divisor)


def ceil_div(x: Column, divisor: int) -> Column:
    return int_div(x + lng(divisor - 1), divisor)
