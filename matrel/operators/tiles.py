"""Direct-address products: joins of tiles, summed in numpy workspaces.

A tile holds the entries of ROWS x COLUMNS coordinates, so its list is bounded
whatever the skew. Tiles of A and B meet on their contraction block in a Spark
join; each task adds the products of its pairs into workspaces of one output
tile each and emits the touched cells as partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import int_div, lng
from matrel.operators.joins import JoinShape, Limits, balanced, join_shape, spread_join

TILE_ROWS = 64
TILE_INNER = 512
TILE_COLUMNS = 1024
OPEN_WORKSPACES = 128      # 64 x 1024 doubles each
EXPANSION = 1 << 21        # products expanded at once
FEW_PRODUCTS = 1 << 13     # below this, single additions beat a pass over the workspace
MATMUL_FACTOR = 64         # products per cell-step at which a matrix product wins
PAIRS_PER_CELL = 1 << 10
PAIR_PRODUCTS = 64         # below this, a pair of tiles costs more than its products


def tiles(entries: DataFrame, row_size: int, column_size: int, row: str, column: str) -> DataFrame:
    """(row block, column block, list of (row offset, column offset, value))."""
    i, j = int_div(F.col("r"), row_size), int_div(F.col("c"), column_size)
    item = F.struct(
        (F.col("r") - F.col(row) * lng(row_size)).cast("int").alias("x"),
        (F.col("c") - F.col(column) * lng(column_size)).cast("int").alias("y"),
        F.col("v").cast("double").alias("v"),
    )
    return (
        entries.withColumn(row, i).withColumn(column, j)
        .groupBy(row, column).agg(F.collect_list(item).alias(f"items_{row}"))
    )


class Workspaces:
    """Partial sums of the output tiles a task has seen and not yet emitted."""

    def __init__(self, structural: bool):
        self.structural = structural
        self.values: dict[tuple[int, int], np.ndarray] = {}
        self.touched: dict[tuple[int, int], np.ndarray] = {}

    def add(self, tile: tuple[int, int], a: tuple, b: tuple) -> None:
        size = TILE_ROWS * TILE_COLUMNS
        if tile not in self.values:
            self.values[tile] = np.zeros(size)
            self.touched[tile] = np.zeros(size, bool)
        values, touched = self.values[tile], self.touched[tile]
        (ax, ak, av), (bk, bc, bv) = a, b
        lengths = np.bincount(bk, minlength=TILE_INNER)
        per_entry = lengths[ak]
        work = int(per_entry.sum())
        if work * MATMUL_FACTOR > size * TILE_INNER and np.isfinite(av).all() and np.isfinite(bv).all():
            left = np.zeros((TILE_ROWS, TILE_INNER))
            right = np.zeros((TILE_INNER, TILE_COLUMNS))
            left[ax, ak], right[bk, bc] = av, bv
            values += (left @ right).ravel()
            if self.structural:
                here = np.zeros_like(left, np.float32)
                there = np.zeros_like(right, np.float32)
                here[ax, ak], there[bk, bc] = 1, 1
                touched |= (here @ there > 0).ravel()
            else:
                touched |= values != 0
            return
        order = np.argsort(bk, kind="stable")
        bc, bv = bc[order], bv[order]
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        ends = np.cumsum(per_entry)
        begin = 0
        while begin < len(ak):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + EXPANSION, "right")))
            counts = per_entry[begin:end]
            total = int(counts.sum())
            source = np.repeat(np.arange(begin, end), counts)
            inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            at = starts[ak[source]] + inner
            cell = ax[source] * TILE_COLUMNS + bc[at]
            products = av[source] * bv[at]
            if total < FEW_PRODUCTS:
                np.add.at(values, cell, products)
            else:
                values += np.bincount(cell, weights=products, minlength=size)
            touched[cell] = True
            begin = end

    def emit(self) -> Iterator[pa.RecordBatch]:
        for (i, j), values in self.values.items():
            touched = self.touched[(i, j)]
            if not self.structural:
                touched = touched & (values != 0)
            at = np.flatnonzero(touched)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(i * TILE_ROWS + at // TILE_COLUMNS),
                        pa.array(j * TILE_COLUMNS + at % TILE_COLUMNS),
                        pa.array(values[at]),
                    ],
                    names=["r", "c", "v"],
                )
        self.values.clear()
        self.touched.clear()


def _items(column: pa.ListArray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    items = column[at].values
    return tuple(items.field(f).to_numpy(zero_copy_only=False) for f in range(3))


def add_pairs(structural: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tiles = Workspaces(structural)
        for batch in batches:
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            a, b = batch.column("items_i"), batch.column("items_kb")
            for at in range(batch.num_rows):
                tile = (int(i[at]), int(j[at]))
                if tile not in open_tiles.values and len(open_tiles.values) >= OPEN_WORKSPACES:
                    yield from open_tiles.emit()
                open_tiles.add(tile, _items(a, at), _items(b, at))
        yield from open_tiles.emit()

    return run


def _keys(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tiles that A and B occupy."""
    left = a.select(int_div(F.col("r"), TILE_ROWS).alias("i"), int_div(F.col("c"), TILE_INNER).alias("k")).distinct()
    return left, b.select(int_div(F.col("r"), TILE_INNER).alias("kb"), int_div(F.col("c"), TILE_COLUMNS).alias("j")).distinct()


def _small(rows: int, b: DataFrame, limits: Limits) -> bool:
    """Tiles are weighed by their entries, about 40 bytes each as structs, not by their number."""
    return limits.broadcasts(5 * rows, b.select("r"))


def tiled(a: DataFrame, b: DataFrame, shape: JoinShape, limits: Limits = Limits()) -> bool:
    """Whether B is small enough to send its tiles to every task, and pairs of tiles make enough products to repay their workspaces."""
    if not _small(shape.right_rows, b, limits):
        return False
    left, right = _keys(a, b)
    return join_shape(left, "k", right, "kb", limits).pairs * PAIR_PRODUCTS <= shape.pairs


def tile_products(a: DataFrame, b: DataFrame, limits: Limits = Limits(),
                  keep_structural: bool = False) -> DataFrame:
    """Partial sums (r, c, v) of A x B; one cell may appear once per task."""
    left = tiles(a, TILE_ROWS, TILE_INNER, "i", "k")
    right = tiles(b, TILE_INNER, TILE_COLUMNS, "kb", "j")
    small = _small(b.count(), b, limits)
    tile_limits = Limits(
        broadcast_values=limits.broadcast_values if small else 0,
        pairs_per_cell=min(PAIRS_PER_CELL, limits.pairs_per_cell),
        pairs_per_task=PAIRS_PER_CELL,
    )
    left_keys, right_keys = _keys(a, b)
    shape = join_shape(left_keys, "k", right_keys, "kb", tile_limits)
    # Whole row blocks per task keep few workspaces open; a long block is spread by tile.
    by = ["i"] if small and balanced(left_keys, "i", "k", shape, tile_limits) else ["i", "k"]
    pairs = spread_join(left, "k", ["i", "k"], right, "kb", ["j"], shape, tile_limits, spread_by=by)
    # Spark sorts the pairs by output tile so that few workspaces are open at once.
    ordered = pairs.select("i", "j", "items_i", "items_kb").sortWithinPartitions("i", "j")
    return ordered.mapInArrow(add_pairs(keep_structural), "r long, c long, v double")
