"""Products summed where their cells live: entries are exchanged once, products never.

A is cut into blocks of whole rows, B into classes of columns; both are staged. One task holds the
B entries of a class by their row and streams a share of the blocks of A against them, so its
memory follows neither the products nor the output. Shares and classes meet in a Cartesian product
of their partitions, which reads a side for every task but writes it once: what is exchanged and
kept on disk follows the entries, however many products they make and tasks these take.

An executor of 3 GB with two tasks leaves about 300 MB for the Python worker of each and as much for
the batches that Spark sends it, 10,000 rows or 64 MB in one. Hence the sizes below.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import lng
from matrel.operators.joins import JoinShape, Limits
from matrel.session import stage_values as stage

RIGHT_ENTRIES = 1 << 21        # of B held by a task
LEFT_ENTRIES = 1 << 25         # of A streamed by a task
TASK_SHARES = 64               # a task streams its products, so it takes this many of ``pairs_per_task``
MAX_CELLS = 1 << 16
SORTED_ENTRIES = 1 << 23       # of A sorted by a task
UNEVEN = 4                     # partitions of A for each share of it that are left as they are
PRODUCT_READS = 4              # entries that a task reads in the time of a product that is exchanged
PIECE = 64                     # entries of one list
BLOCK = 1 << 8                 # entries of a block of A; a longer row makes a longer block
TOGETHER = 1 << 8              # blocks of one batch
DEALT = 1 << 18                # B entries dealt to their classes together
PART = 1 << 15                 # most entries of one value of B
BUFFER = 1 << 17               # A entries expanded together
EXPANSION = 1 << 17            # products expanded at once
FILLED = 8                     # workspace cells per product up to which direct addresses beat sorting
_NULL = -(1 << 48)             # stands for a null index
_NUMBER = (1 << 33) - 1        # of a row in its partition, in a monotonically increasing id


@dataclass(frozen=True)
class Grid:
    rows: int
    columns: int

    def copies(self, shape: JoinShape) -> int:
        """Entries that all tasks read."""
        return shape.left_rows * self.columns + shape.right_rows * self.rows


@dataclass(frozen=True)
class Fold:
    """What a task makes of its cells; those of one row and column are one cell of one task."""

    run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
    schema: str


def grid_of(shape: JoinShape, limits: Limits) -> Grid:
    """Classes that bound both sides of a task, in the ratio that copies the fewest entries."""
    tasks = max(shape.degrees.sparkSession.sparkContext.defaultParallelism, math.ceil(shape.pairs / (TASK_SHARES * limits.pairs_per_task)))
    tasks = min(tasks, MAX_CELLS)
    square = math.sqrt(tasks * max(1, shape.right_rows) / max(1, shape.left_rows))
    columns = max(1, -(-shape.right_rows // RIGHT_ENTRIES), min(tasks, round(square)))
    rows = max(1, -(-shape.left_rows // LEFT_ENTRIES), -(-tasks // columns))
    if columns > MAX_CELLS:
        raise ValueError(f"{shape.right_rows} entries need {columns} column classes; restrict the columns")
    return Grid(min(rows, MAX_CELLS // columns), columns)


def repays(shape: JoinShape, limits: Limits) -> bool:
    """Whether there are more products than one task would sum, and their exchange would cost more than the reads of entries."""
    return shape.pairs > limits.pairs_per_task and grid_of(shape, limits).copies(shape) < PRODUCT_READS * shape.pairs


def _packed(width: int):
    """Short lists of the entries of one key and class, which keep the sort of the exchange small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, key, x = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            values = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(width)]
            if not len(key):
                continue
            order = np.lexsort((key, own))
            own, key, x = own[order], key[order], x[order]
            v = values[0][order] if width == 1 else np.column_stack(values)[order].ravel()
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])))
            starts = np.flatnonzero(fresh)
            at = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key))))
            starts = np.flatnonzero(at % PIECE == 0)
            offsets = np.append(starts, len(key)).astype(np.int32)
            xs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))
            vs = pa.ListArray.from_arrays(pa.array(offsets * np.int32(width)), pa.array(v))
            yield pa.RecordBatch.from_arrays([pa.array(own[starts].astype(np.int32)), pa.array(key[starts]), xs, vs], names=["own", "s", "x", "v"])

    return run


def _to_bytes(key: np.ndarray, x: np.ndarray, v: np.ndarray) -> bytes:
    """Entries as one value, each column in 4 bytes where these hold all its numbers."""
    columns = []
    for column, narrow in ((key, np.int32), (x, np.int32), (v, np.float32)):
        with np.errstate(over="ignore"):
            less = column.astype(narrow)
        columns.append(less if np.array_equal(less, column, equal_nan=narrow is np.float32) else column)
    head = np.array([len(key), *(c.itemsize for c in columns)], np.int64)
    return b"".join(c.tobytes() for c in (head, *columns))


def _views(data: bytes | memoryview, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of such a value, as they lie in it."""
    n, *sizes = np.frombuffer(data, np.int64, 4).tolist()
    begin, columns = 32, []
    for size, kind, many in zip(sizes, "iif", (1, 1, width)):
        columns.append(np.frombuffer(data, f"{kind}{size}", n * many, begin))
        begin += n * many * size
    key, x, v = columns
    return key, x, v if width == 1 else v.reshape(-1, width)


def _from_bytes(data: bytes | memoryview, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, x, v = _views(data, width)
    return key.astype(np.int64), x.astype(np.int64), v.astype(np.float64)


def _dealt(width: int, classes: int):
    """Entries (own, key, x, ..) in values ``own, data`` of one class each, in any order."""
    most = max(DEALT, PIECE * classes)

    def values_of(waiting: list[tuple]) -> pa.RecordBatch:
        own, key, x, *values = (np.concatenate(column) for column in zip(*waiting))
        order = np.argsort(own, kind="stable")
        own, key, x = own[order], key[order], x[order]
        v = values[0][order] if width == 1 else np.column_stack(values)[order]
        owns, data = [], []
        starts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
        for begin, end in zip(starts, [*starts[1:], len(own)]):
            for at in range(begin, end, PART):
                some = slice(at, min(end, at + PART))
                owns.append(own[at])
                data.append(_to_bytes(key[some], x[some], v[some].ravel()))
        return pa.RecordBatch.from_arrays([pa.array(np.array(owns, np.int32)), pa.array(data, pa.binary())], names=["own", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(tuple(column.to_numpy(zero_copy_only=False) for column in batch.columns))
                size += batch.num_rows
            if size >= most:
                yield values_of(waiting)
                waiting, size = [], 0
        if waiting:
            yield values_of(waiting)

    return run


def _blocks(width: int, whole_keys: bool):
    """The lists of a partition (one class, in the order of its keys) in few large values ``own, block, last, data``.

    With ``whole_keys`` no key lies in two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number, waiting, own = [], 0, 0, None, 0

        def batch_of(last: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([own], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([last]), pa.array([waiting], pa.binary())],
                names=["own", "block", "last", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(0)[0].as_py()
            xs, vs = batch.column(2), batch.column(3)
            offsets, wide = xs.offsets.to_numpy(), vs.offsets.to_numpy()
            key, x, v = np.repeat(batch.column(1).to_numpy(), np.diff(offsets)), xs.values.to_numpy(), vs.values.to_numpy()
            x, v = x[offsets[0]:offsets[-1]], v[wide[0]:wide[-1]]
            begin = 0
            while begin < len(key):
                end = min(len(key), begin + max(1, BLOCK - size))
                if size >= BLOCK and whole_keys and key[begin] == parts[-1][0][-1]:      # the row goes on
                    end = int(np.searchsorted(key, key[begin], "right"))
                elif size >= BLOCK:
                    if waiting is not None:
                        yield batch_of(False)
                    waiting, number = _to_bytes(*(np.concatenate([part[i] for part in parts]) for i in range(3))), number + 1
                    parts, size = [], 0
                    continue
                parts.append((key[begin:end], x[begin:end], v[begin * width:end * width]))
                size += end - begin
                begin = end
        if parts:
            if waiting is not None:
                yield batch_of(False)
            waiting, number = _to_bytes(*(np.concatenate([part[i] for part in parts]) for i in range(3))), number + 1
            yield batch_of(True)

    return run


def _together(run):
    """``run`` with ``TOGETHER`` of its batches as one."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = run(batches)
        while some := list(islice(made, TOGETHER)):
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()

    return joined


class Block:
    """The B entries of one cell of the grid, and the rows of A that have not been put out yet."""

    def __init__(self, width: int, structural: bool, direct: bool):
        self.width, self.structural, self.direct = width, structural, direct
        self.right: list[tuple] = []
        self.left: list[tuple] = []
        self.waiting = 0
        self.carry = None          # (row, column codes, sums) of a row that may go on
        self.built = False

    def add_right(self, key: np.ndarray, x: np.ndarray, v: np.ndarray) -> None:
        self.right.append((key, x, v))

    def add_left(self, key: np.ndarray, x: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.right or self.built:               # without B entries there is nothing to meet
            self.left.append((key, x, v))
            self.waiting += len(key)
            if self.waiting >= BUFFER:
                yield from self._flush()

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._flush()
        if self.carry is not None:
            row, codes, sums = self.carry
            yield from self._batch(np.full(len(codes), row), codes, sums)
            self.carry = None

    def _build(self) -> None:
        """One column after the other, as each takes several times its size while it is made."""
        keys, xs, vs = (list(column) for column in zip(*self.right))
        self.right, self.built = [], True
        key = np.concatenate(keys)
        keys.clear()
        order = None
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key = key[order]
        self.low, span = int(key[0]), int(key[-1]) - int(key[0]) + 1
        if span <= max(1 << 20, 2 * len(key)):
            self.keys = None
            self.starts = np.zeros(span + 1, np.int32)
            np.cumsum(np.bincount(key - key[0], minlength=span), dtype=np.int32, out=self.starts[1:])
        else:
            first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            self.keys, self.starts = key[first].astype(np.int64), np.append(first, len(key))
        del key
        v = np.concatenate(vs)
        vs.clear()
        self.values = v if order is None else v[order]
        del v
        x = np.concatenate(xs)
        xs.clear()
        x = x if order is None else x[order]
        low, span = int(x.min()), int(x.max()) - int(x.min()) + 1
        if span <= max(1 << 20, 4 * len(x)):
            x = x.astype(np.int64) - low
            seen = np.zeros(span, bool)
            seen[x] = True
            self.columns = np.flatnonzero(seen) + low
            self.codes = (np.cumsum(seen, dtype=np.int32) - np.int32(1))[x]
        else:
            self.columns, codes = np.unique(x, return_inverse=True)
            self.columns, self.codes = self.columns.astype(np.int64), codes.astype(np.int32)

    def _met(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First B entry and number of B entries of each contraction index."""
        if self.keys is None:
            at = k - self.low
            inside = (at >= 0) & (at < len(self.starts) - 1)
            at = np.where(inside, at, 0)
        else:
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            inside = self.keys[at] == k
        return self.starts[at], np.where(inside, self.starts[at + 1] - self.starts[at], 0)

    def _flush(self) -> Iterator[pa.RecordBatch]:
        if not self.left:
            return
        if not self.built:
            self._build()
        r, k, va = (np.concatenate([part[i] for part in self.left]).astype(kind, copy=False) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        self.left, self.waiting = [], 0
        first, counts = self._met(k)
        if counts.max() > EXPANSION:               # a long row of B is taken in pieces
            pieces = -(-counts // EXPANSION)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            r, va, first, counts = (np.repeat(y, pieces) for y in (r, va, first, counts))
            first, counts = first + step * EXPANSION, np.minimum(counts - step * EXPANSION, EXPANSION)
        met = counts > 0
        r, va, first, counts = r[met], va[met], first[met], counts[met]
        ends = np.cumsum(counts)
        begin = 0
        while begin < len(r):
            base = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, base + EXPANSION, "right")))
            some = slice(begin, end)
            yield from self._sum(r[some], va[some], first[some], counts[some])
            begin = end

    def _sum(self, r: np.ndarray, va: np.ndarray, first: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        before = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(first - before, counts)
        scale = np.repeat(va, counts)
        if self.width == 1:
            products = scale * self.values[at]
        else:
            products = scale[:, None] * self.values[at]
        fresh = np.concatenate(([True], r[1:] != r[:-1]))
        rows = r[fresh]
        m = len(self.columns)
        keys = np.repeat((np.cumsum(fresh) - 1) * m, counts) + self.codes[at]
        if self.carry is not None:
            row, codes, sums = self.carry
            if row == rows[0]:
                keys, products = np.concatenate((codes, keys)), np.concatenate((sums, products))
            else:
                yield from self._batch(np.full(len(codes), row), codes, sums)
        size = len(rows) * m
        if self.direct and size <= FILLED * len(keys):
            sums = [np.bincount(keys, weights=x, minlength=size) for x in ([products] if self.width == 1 else products.T)]
            cells = np.flatnonzero(np.bincount(keys, minlength=size) if self.structural or self.width > 1 else sums[0])
            sums = sums[0][cells] if self.width == 1 else np.column_stack([x[cells] for x in sums])
        else:
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            cells, sums = keys[starts], np.add.reduceat(products[order], starts, axis=0)
        last = int(np.searchsorted(cells, (len(rows) - 1) * m))
        self.carry = (rows[-1], cells[last:] - (len(rows) - 1) * m, sums[last:])
        cells, sums = cells[:last], sums[:last]
        yield from self._batch(rows[cells // m], cells % m, sums)

    def _batch(self, r: np.ndarray, codes: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.structural:
            kept = sums != 0 if self.width == 1 else np.ones(len(sums), bool)
            if not kept.all():
                r, codes, sums = r[kept], codes[kept], sums[kept]
        if len(r):
            index = lambda y: pa.array(y, mask=y == _NULL) if (y == _NULL).any() else pa.array(y)
            values = [sums] if self.width == 1 else [np.ascontiguousarray(sums[:, i]) for i in range(self.width)]
            yield pa.RecordBatch.from_arrays([index(r), index(self.columns[codes]), *map(pa.array, values)],
                                             names=["r", "c", *[f"v{i}" for i in range(self.width)]])


def _summed(width: int, structural: bool, direct: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first = Block(width, structural, direct), None
        for batch in batches:
            right, left = batch.columns
            for of_b, of_a in zip(_buffers(right), _buffers(left)):
                if of_b is not None:
                    block.add_right(*(np.array(y) for y in _views(of_b, width)))
                    if of_a is not None:                       # before B is complete
                        first = bytes(of_a)
                elif of_a is not None:
                    if first is not None:
                        yield from _streamed(block, first)
                        first = None
                    yield from _streamed(block, of_a)
        if first is not None:
            yield from _streamed(block, first)
        yield from block.finish()

    return run


def _buffers(values: pa.BinaryArray) -> Iterator[memoryview | None]:
    """The values of an array, not copied."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).tolist() if len(values) else []
    data = memoryview(values.buffers()[2] or b"")
    for valid, begin, end in zip(values.is_valid().to_pylist(), offsets, offsets[1:]):
        yield data[begin:end] if valid else None


def _streamed(block: Block, data: bytes | memoryview) -> Iterator[pa.RecordBatch]:
    key, x, v = (np.array(y) for y in _views(data, 1))         # copies, as they outlive the batch
    for begin in range(0, len(key), BUFFER):
        yield from block.add_left(*(y[begin:begin + BUFFER] for y in (key, x, v)))


def _staged_left(entries: DataFrame, classes: int) -> DataFrame:
    """``data`` of entries (own, r, k, va), staged: blocks of whole rows."""
    lists = entries.mapInArrow(_packed(1), "own int, s long, x array<long>, v array<double>")
    dealt = lists.repartitionById(classes, F.col("own")).sortWithinPartitions("s")
    return stage(dealt.mapInArrow(_together(_blocks(1, True)), "own int, block int, last boolean, data binary"))


def _shares(blocks: DataFrame, rows: int) -> DataFrame:
    """``blocks`` in about ``rows`` partitions: a few more as Spark reads them rather than as many of unequal size."""
    return blocks.coalesce(rows) if blocks.rdd.getNumPartitions() > UNEVEN * rows else blocks


def _staged_right(entries: DataFrame, classes: int, width: int) -> DataFrame:
    """``own, data`` of entries (own, kb, c, ..), staged: values of one class each."""
    return stage(entries.mapInArrow(_dealt(width, classes), "own int, data binary"))


def grid_sums(left: DataFrame, right: DataFrame, values: list[str], shape: JoinShape, limits: Limits = Limits(),
              structural: bool = True, direct: bool = False, fold: Fold | None = None) -> DataFrame:
    """(r, c, v0, ..): per row of A and column of B the sum of ``va`` times each of ``values``, over the common index.

    ``left`` has (r, k, va), ``right`` (kb, c, *values). Cells are summed by sorting, or with
    ``direct`` by address where the products fill the workspace. A ``fold`` takes the cells in the
    task that has summed them, so that only what it makes of them leaves the task.
    """
    grid, width = grid_of(shape, limits), len(values)
    code = lambda name: F.coalesce(F.col(name), lng(_NULL))
    double = lambda name: F.col(name).cast("double")
    of = lambda name, classes: F.pmod(F.xxhash64(name), lng(classes))
    sorters = max(grid.rows, -(-shape.left_rows // SORTED_ENTRIES), shape.degrees.sparkSession.sparkContext.defaultParallelism)
    a = left.filter("k IS NOT NULL AND va IS NOT NULL").select(of("r", sorters), code("r"), "k", double("va"))
    known = " AND ".join(f"{x} IS NOT NULL" for x in ["kb", *values])
    b = right.filter(known).select(of("c", grid.columns), "kb", code("c"), *map(double, values))
    # blocks of A may lie anywhere, as they hold whole rows; a class of B is one partition
    turn = F.monotonically_increasing_id().bitwiseAND(lng(_NUMBER))
    a = _shares(_staged_left(a, sorters), grid.rows).select(turn.alias("turn"), F.col("data").alias("left"))
    b = _staged_right(b, grid.columns, width).repartitionById(grid.columns, F.col("own")).select(turn.alias("turn_b"), F.col("data").alias("right"))
    # a task takes B with its first block of A, and each block of A with the first value of B
    met = a.crossJoin(b.hint("shuffle_replicate_nl")).filter("turn = 0 OR turn_b = 0")
    dealt = met.select(F.when(F.col("turn") == 0, F.col("right")), F.when(F.col("turn_b") == 0, F.col("left")))
    run = _summed(width, structural, direct)
    if fold is not None:
        return dealt.mapInArrow(lambda batches: fold.run(run(batches)), fold.schema)
    return dealt.mapInArrow(run, "r long, c long, " + ", ".join(f"v{i} double" for i in range(width)))
