"""Packing of tokenized documents into sequences of bounded length by sums of squares.

A document is its byte-level BPE ids and one end id. One longer than a sequence is cut into
pieces of the full length, its first piece taking what is left over. Pieces of the full length
are sequences of their own. The others are dealt at random to groups of about ``GROUP_ROWS``
pieces, and each group is packed by one task: pieces in falling length, each into the open
sequence that makes the sum of the squared numbers of open sequences per residual gap
smallest (of equal ones, the tightest). A new sequence opens only where no open one fits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import batches_of
from matrel.llm.tokens import encoder
from matrel.session import stage

CAPACITY = 2048
END_ID = 0
GROUP_ROWS = 20_000
_CLOSED = np.iinfo(np.int64).max


class SumOfSquares:
    """Online packer; ``place`` gives the bin and the offset of a piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, dtype=np.int64)          # open bins per residual gap
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, length: int) -> tuple[int, int]:
        cap, n = self.capacity, self.open
        if length < cap:
            here = n[length:cap]
            # moving one bin from gap g to gap g - length changes the sum by 2 n[g - length] - 2 n[g] + 2
            change = np.where(here > 0, 2 * n[:cap - length] - 2 * here + 2, _CLOSED)
            if here[0]:
                change[0] = 1 - 2 * here[0]                          # filled bins leave the sum
            best = int(change.argmin())
            if change[best] != _CLOSED:
                gap = length + best
                bin_ = self.bins[gap].pop()
                self._put(bin_, gap, -1)
                self._put(bin_, best, 1)
                return bin_, cap - gap
        bin_, self.used = self.used, self.used + 1
        self._put(bin_, cap - length, 1)
        return bin_, 0

    def _put(self, bin_: int, gap: int, step: int) -> None:
        if gap:
            self.open[gap] += step
            if step > 0:
                self.bins[gap].append(bin_)


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, piece, start, length, ids_crc32, spread`` and, if asked, ``ids``.

    ``spread`` is an even random number fixed by the document and its place in its task.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).ids
        row = 0
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                out: list[list] = [[], [], [], [], [], [], []]
                for doc_id, text in zip(*batches_of(batch, "doc_id", "text")):
                    ids = encode(text or "") + end
                    row += 1
                    for piece, (start, length) in enumerate(cut_pieces(len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + length)]
                        crc = zlib.crc32(part)
                        spread = zlib.crc32(b"%d %d" % (row, piece), crc)
                        for column, value in zip(out, (doc_id, piece, start, length, crc, spread, part if keep_ids else None)):
                            column.append(value)
                types = [batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "spread", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, spread long, ids binary"
    pieces = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return pieces if keep_ids else pieces.drop("ids")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS,
                   keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    Null and empty texts are one end token. Repeated rows are packed one by one; equal lengths
    are placed in the order of the doc_id (nulls last) and piece. Other columns are ignored and
    an empty table gives an empty result.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    pieces = stage(token_pieces(docs, path, capacity, keep_ids))
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group_rows))
    pieces = pieces.withColumn("g", F.pmod("spread", F.lit(groups))).drop("spread")
    # the packer reads lengths alone; ids, where kept, join by the row's own number
    id_type = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + (["ids"] if keep_ids else [])

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        # Arrow keeps ids as they are; pandas would turn a long column with nulls into doubles
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending")])
        packer = SumOfSquares(capacity)
        places = [packer.place(n) for n in rows.column("length").to_pylist()]
        group = key[0].as_py() << 32
        rows = rows.select(columns).append_column("sequence_id", pa.array([group + p[0] for p in places], pa.int64()))
        return rows.append_column("offset", pa.array([p[1] for p in places], pa.int64()))

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, " + "ids binary, " * keep_ids + "sequence_id long, offset long"
    short = pieces.filter(F.col("length") < capacity).groupBy("g").applyInArrow(pack, schema)
    full = pieces.filter(F.col("length") == capacity).select(
        *columns, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return short.unionByName(full)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids, ``sequence_id, n_tokens, ids`` (little-endian 32-bit); needs ``keep_ids``. A sequence is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
