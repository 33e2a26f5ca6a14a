"""Order-independent products of single-precision matrices.

A sum of doubles depends on the order of its terms, so two runs, or two forms, of one product may
differ in their last bits. With FLOAT factors every product is exact in a double, and here their sum is
exact as well: a product is written as three integers of 32 bits (limbs) at fixed powers of 2**32, and the limbs are
summed as LONGs per cell and power, with map-side partial sums as any other aggregate. Integers do not care about the order. One
cell then holds one row of sums per power that its products reach, usually one or two and never more than 20; they
are put together and rounded once, to the double nearest to the true sum. Joins, salts, tasks and stages of the
sum have no influence on a single bit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import lng
from matrel.operators.coo import Matrix
from matrel.operators.joins import JoinShape, Limits, join_shape
from matrel.operators.multiply import joined_entries, partial_products

LIMB = 32                          # bits; a cell may sum up to 2**30 products
_BASE = float(1 << LIMB)


def single(entries: DataFrame) -> DataFrame:
    """Entries with their values rounded to FLOAT (kept as DOUBLE)."""
    return entries.select("r", "c", F.col("v").cast("float").cast("double").alias("v"))


def _limbs(products: DataFrame, *keys: str) -> DataFrame:
    """(keys, power, l0, l1, l2) of each finite product p = (l0 * 2**64 + l1 * 2**32 + l2) * 2**(32 * (power - 2)), and ``odd``, the others."""
    p = F.col("p")
    finite = ~F.isnan(p) & (F.abs(p) < math.inf)
    power = F.when(finite & (p != 0), F.floor(F.log2(F.abs(p)) / LIMB)).otherwise(lng(0)).cast("long")
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))          # towards zero: LONG
    # every step is exact: powers of two, and differences of doubles that share their bits
    rows = products.select(*keys, "p", power.alias("power"), F.when(~finite, p).alias("odd"))
    rows = rows.withColumn("x", F.when(F.col("odd").isNull(), p * F.pow(F.lit(2.0), F.col("power") * -LIMB)).otherwise(F.lit(0.0)))
    for name in ("l0", "l1"):
        rows = rows.withColumn(name, whole(F.col("x"))).withColumn("x", (F.col("x") - F.col(name)) * _BASE)
    return rows.select(*keys, "power", "l0", "l1", F.col("x").cast("long").alias("l2"), "odd")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("l0", "l1", "l2", "odd")])


def _rounded(cells: DataFrame) -> DataFrame:
    """(r, c, v, numerator, exponent) of cells with the sums of each power."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, numerators, exponents = [], [], []
            for sums in batch.column(2).to_pylist():
                least = min(s["power"] for s in sums)
                total = sum(((s["l0"] << 2 * LIMB) + (s["l1"] << LIMB) + s["l2"]) << LIMB * (s["power"] - least) for s in sums)
                exponent = LIMB * (least - 2) if total else 0
                odd = [s["odd"] for s in sums if s["odd"] is not None]
                if odd:
                    values.append(math.nan if len({math.isnan(x) or x for x in odd}) > 1 else odd[0])
                    numerators.append(None)
                    exponents.append(None)
                    continue
                shift = (total & -total).bit_length() - 1 if total else 0
                values.append(math.ldexp(float(total), exponent))
                numerators.append(str(total >> shift))
                exponents.append(exponent + shift)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.float64()), pa.array(numerators, pa.string()),
                                              pa.array(exponents, pa.int32())], names=["r", "c", "v", "numerator", "exponent"])

    return cells.mapInArrow(run, "r long, c long, v double, numerator string, exponent int")


def exact_multiply(a: Matrix, b: Matrix | None = None, keep_structural: bool = False, ways: int = 1, limits: Limits = Limits(),
                   shape: JoinShape | None = None) -> DataFrame:
    """A x B over FLOAT values as (r, c, v, numerator, exponent): v is the double nearest to numerator * 2**exponent, the true sum.

    ``ways`` > 1 sums in two stages, split by the contraction index, as heavy rows need it. Sums that
    are not finite have no numerator. Exact zeros are dropped unless ``keep_structural``.
    """
    b = b or a
    left, right = single(a.entries), single(b.entries)
    shape = shape or join_shape(left, "c", right, "r", limits)
    parts = shape.partitions(limits)
    products = joined_entries(left, right, limits, shape)
    if not limits.broadcasts(shape.right_rows, right.select("r", "c", "v")):
        # products are dealt by cell, a third of the size of their limbs; both sums then find their rows in place
        products = products.repartition(max(parts, int(products.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "r", "c")
    if ways > 1:
        rows = _limbs(products.withColumn("way", F.pmod("k", lng(ways))), "r", "c", "way")
        sums = _sums(rows, "r", "c", "way", "power")
        sums = _sums(sums, "r", "c", "power")
    else:
        sums = _sums(_limbs(products, "r", "c"), "r", "c", "power")
    cells = sums.groupBy("r", "c").agg(F.collect_list(F.struct("power", "l0", "l1", "l2", "odd")).alias("sums"))
    found = _rounded(cells)
    return found if keep_structural else found.filter((F.col("v") != 0) | F.isnan("v"))


def single_multiply(a: Matrix, b: Matrix | None = None, limits: Limits = Limits()) -> DataFrame:
    """A x B in single precision: FLOAT factors, each product rounded to FLOAT, and their sum too.

    This is the product whose deviation the rounding bound of ``verify`` speaks about.
    """
    products = partial_products(single(a.entries), single((b or a).entries), limits)
    rounded: Column = F.sum(F.col("p").cast("float").cast("double")).cast("float").cast("double")
    return products.groupBy("r", "c").agg(rounded.alias("v")).filter(F.col("v") != 0)
