"""Matrix Market coordinate files as a Spark data source, for reading and writing.

``spark.read.format("mtx").load(path)`` gives ``r, c, v`` (0-based); ``register`` makes the format known
to a session. A path is one file or a folder of parts in name order, header part first. The driver
reads the header and the size line, nothing else; tasks read byte ranges of ``split_bytes`` each, and
a ``.gz`` part, which cannot be entered in the middle, as a whole stream. Filters on r and c are taken by
the source, so other rows never leave the Python worker.

Rules: the header must name ``matrix coordinate``; ``pattern`` entries are 1; symmetric, hermitian
and skew files are mirrored (not with ``mirror=false``); blank and ``%`` lines are skipped anywhere; words
after the value are ignored; indices are 1-based and checked. ``read_matrix_market`` also checks that the number of
entries is the declared one, sums duplicates and drops exact zeros.

``df.write.format("mtx").mode("append").save(folder)`` writes a folder of parts. Each task writes its
own file below a temporary folder and reports its entries; only the commit, which knows their sum, writes the
size line, in a part that comes first by name, and moves the files to their places.
"""

from __future__ import annotations

import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, WriterCommitMessage)

from matrel.operators.coo import Matrix, canonical, mirrored
from matrel.session import stage

SPLIT_BYTES = 64 << 20
CHUNK_BYTES = 4 << 20
SCHEMA = "r long, c long, v double"
SYMMETRIES = ("general", "symmetric", "hermitian", "skew-symmetric")
FIELDS = ("real", "integer", "pattern")


class MatrixMarketError(ValueError):
    pass


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:/", path) else (fs.LocalFileSystem(), path)


def _parts(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """The files of a path in name order; hidden ones are left out."""
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [info]
    if info.type != fs.FileType.Directory:
        raise FileNotFoundError(path)
    files = [f for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f for f in files if f.size), key=lambda f: f.base_name)


def _open(system: fs.FileSystem, path: str):
    return system.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None, buffer_size=1 << 16)


@dataclass(frozen=True)
class Header:
    """Form and sizes of a matrix, and where its entries begin: a part and an offset in its (inflated) text."""

    field: str
    symmetry: str
    n: int
    entries: int
    part: int
    offset: int

    @property
    def sign(self) -> int:
        """Of mirrored entries; 0 if none are."""
        return {"general": 0, "skew-symmetric": -1}.get(self.symmetry, 1)


def read_header(path: str) -> Header:
    """Header and size line, from the first bytes of the file or of the first parts of a folder."""
    system, inner = file_system(path)
    first = None
    for number, info in enumerate(_parts(system, inner)):
        with _open(system, info.path) as stream:
            rest, at = b"", 0
            while True:
                data = stream.read(1 << 14)
                lines = (rest + data).split(b"\n")
                rest = lines.pop() if data else b""
                for line in lines:
                    at += len(line) + 1
                    text = line.decode("latin-1").strip()
                    if first is None:
                        if not text:
                            continue
                        first = text.lower()
                        if "matrix coordinate" not in first or " complex" in first:
                            raise MatrixMarketError("unsupported Matrix Market type")
                    elif text and not text.startswith("%"):
                        return _sized(first, text, number, at)
                if not data:
                    break
    raise MatrixMarketError("missing dimensions" if first else "unsupported Matrix Market type")


def _sized(first: str, size_line: str, part: int, offset: int) -> Header:
    sizes = size_line.split()[:3]
    if len(sizes) < 3 or not all(s.isascii() and s.isdigit() for s in sizes):
        raise MatrixMarketError("missing dimensions")
    rows, columns, entries = map(int, sizes)
    if rows == 0 or rows != columns:
        raise MatrixMarketError("a square matrix is required")
    words = first.split()
    symmetry = next((s for s in SYMMETRIES if s in words), "general")
    return Header("pattern" if "pattern" in words else "real", symmetry, rows, entries, part, offset)


# --- reading -----------------------------------------------------------------------------------

@dataclass
class Span(InputPartition):
    """Lines that begin in [begin, end) of a part; ``end`` is None for a stream read to its end."""

    path: str
    begin: int
    end: int | None
    at_line: bool           # whether a line begins at ``begin``


def _numbers(words: list[bytes], kind: pa.DataType) -> pa.Array:
    column = pa.array(words, pa.binary()).cast(pa.string())
    try:
        return column.cast(kind)
    except pa.ArrowInvalid:
        try:
            return pc.replace_substring_regex(column, r"^\+", "").cast(kind)
        except pa.ArrowInvalid as error:
            raise MatrixMarketError(f"invalid Matrix Market entry: {error}") from None


def parse_lines(lines: list[bytes], n: int, pattern: bool) -> pa.RecordBatch:
    """The entries of some lines, indices from 0."""
    wanted = 2 if pattern else 3
    rows = [line.split(None, wanted) for line in lines]
    rows = [row for row in rows if row and not row[0].startswith(b"%")]
    if any(len(row) < wanted for row in rows):
        raise MatrixMarketError("invalid Matrix Market entry: too few words")
    r, c = (_numbers([row[i] for row in rows], pa.int64()).to_numpy(zero_copy_only=False) for i in (0, 1))
    if len(rows) and not (min(r.min(), c.min()) >= 1 and max(r.max(), c.max()) <= n):
        raise MatrixMarketError("invalid Matrix Market entry: index out of range")
    v = pa.array(np.ones(len(rows))) if pattern else _numbers([row[2] for row in rows], pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(r - 1), pa.array(c - 1), v], names=["r", "c", "v"])


def _lines(stream, size: int | None) -> Iterator[list[bytes]]:
    """Whole lines of a stream in chunks: those that begin in its next ``size`` bytes."""
    rest, left = b"", size
    while left is None or left > 0:
        data = stream.read(CHUNK_BYTES if left is None else min(CHUNK_BYTES, left))
        if not data:
            break
        if left is not None:
            left -= len(data)
        lines = (rest + data).split(b"\n")
        rest = lines.pop()
        yield lines
    # the line that the end of the range cuts belongs to it; a line that begins at the end does not
    while rest and left is not None:
        data = stream.read(1 << 12)
        if not data:
            break
        line, found, _ = data.partition(b"\n")
        rest += line
        if found:
            break
    if rest:
        yield [rest]


_TESTS = {
    EqualTo: pc.equal, EqualNullSafe: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal,
    LessThan: pc.less, LessThanOrEqual: pc.less_equal, In: lambda column, values: pc.is_in(column, pa.array(list(values), pa.int64()))}


class MatrixMarketReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        given = options.get("found_header")
        self.header = Header(**json.loads(given)) if given else read_header(self.path)
        self.mirror = options.get("mirror", "true").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if isinstance(test, IsNotNull):             # no value of an entry is null
                continue
            if type(test) in _TESTS and test.attribute in (("r",), ("c",)) and test.value is not None:
                self.filters.append((test.attribute[0], test))
            else:
                yield test

    def partitions(self) -> list[Span]:
        system, inner = file_system(self.path)
        spans = []
        for number, info in enumerate(_parts(system, inner)):
            if number < self.header.part:
                continue
            begin = self.header.offset if number == self.header.part else 0
            if info.path.endswith(".gz"):
                spans.append(Span(info.path, begin, None, True))
                continue
            for at in range(begin, info.size, self.split):
                spans.append(Span(info.path, at, min(at + self.split, info.size), at == begin))
        return spans

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is None:               # Spark's call where there are no partitions
            return
        system, _ = file_system(self.path)
        if partition.end is None:
            stream = _open(system, partition.path)
            left = partition.begin
            while left:
                left -= len(stream.read(min(left, CHUNK_BYTES)))
            size = None
        else:
            stream = system.open_input_file(partition.path)
            begin = partition.begin
            if not partition.at_line:
                stream.seek(begin - 1)                  # a line that begins here has its line end before it
                while begin < partition.end:
                    data = stream.read(1 << 12)
                    found = data.find(b"\n")
                    if found >= 0 or not data:
                        begin = stream.tell() - len(data) + found + 1 if data else partition.end
                        break
            stream.seek(begin)
            size = partition.end - begin
        with stream:
            for lines in _lines(stream, size):
                batch = self._selected(parse_lines(lines, self.header.n, self.header.field == "pattern"))
                if batch.num_rows:
                    yield batch

    def _selected(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if self.mirror and self.header.sign:
            r, c, v = batch.columns
            off = pc.not_equal(r, c)
            back = pa.RecordBatch.from_arrays([c.filter(off), r.filter(off), pc.multiply(v.filter(off), float(self.header.sign))], names=["r", "c", "v"])
            batch = pa.concat_batches([batch, back])
        for name, test in self.filters:
            batch = batch.filter(_TESTS[type(test)](batch.column(name), test.value))
        return batch


# --- writing -----------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    name: str
    entries: int
    largest: int


class MatrixMarketWriter(DataSourceArrowWriter):
    """Options: ``n`` (else the largest index), ``field``, ``symmetry`` (the caller passes one triangle), ``compression`` gzip or none."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.n = int(options["n"]) if "n" in options else None
        self.field, self.symmetry = options.get("field", "real"), options.get("symmetry", "general")
        if self.field not in FIELDS or self.symmetry not in SYMMETRIES:
            raise MatrixMarketError(f"unsupported form: {self.field} {self.symmetry}")
        self.ending = ".mtx.gz" if options.get("compression") == "gzip" else ".mtx"
        self.job = uuid.uuid4().hex
        system, inner = file_system(self.path)
        if not overwrite and system.get_file_info(inner).type == fs.FileType.Directory and _parts(system, inner):
            raise MatrixMarketError("the folder holds files; a matrix cannot be appended to, its size line is fixed")

    def _folder(self) -> tuple[fs.FileSystem, str, str]:
        system, inner = file_system(self.path)
        return system, inner, posixpath.join(inner, f"_temporary-{self.job}")

    def _create(self, system: fs.FileSystem, path: str):
        return system.open_output_stream(path, compression="gzip" if self.ending.endswith(".gz") else None)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, _, temporary = self._folder()
        name = f"part-{TaskContext.get().partitionId() + 1:08d}-{uuid.uuid4().hex}{self.ending}"
        entries, largest, out = 0, -1, None
        for batch in iterator:
            if any(column.null_count for column in batch.columns):
                raise MatrixMarketError("an entry has a null")
            if not batch.num_rows:
                continue
            r, c = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in "rc")
            if min(r.min(), c.min()) < 0 or (self.n is not None and max(r.max(), c.max()) >= self.n):
                raise MatrixMarketError("index out of range")
            if out is None:
                system.create_dir(temporary, recursive=True)
                out = self._create(system, posixpath.join(temporary, name))
            entries, largest = entries + len(r), max(largest, int(r.max()), int(c.max()))
            columns = [(r + 1).tolist(), (c + 1).tolist()]
            if self.field == "pattern":
                lines = [f"{x} {y}\n" for x, y in zip(*columns)]
            else:
                values = batch.column(batch.schema.get_field_index("v")).to_pylist()
                spell = (lambda v: str(int(v))) if self.field == "integer" else repr
                lines = [f"{x} {y} {spell(v)}\n" for x, y, v in zip(*columns, values)]
            out.write("".join(lines).encode())
        if out is not None:
            out.close()
        return Written(name if entries else "", entries, largest)

    def commit(self, messages: list[Written | None]) -> None:
        system, inner, temporary = self._folder()
        written = [m for m in messages if m is not None and m.entries]
        n = self.n if self.n is not None else max((m.largest + 1 for m in written), default=0)
        system.create_dir(temporary, recursive=True)
        head = f"part-00000000-{self.job}{self.ending}"
        with self._create(system, posixpath.join(temporary, head)) as out:
            out.write(f"%%MatrixMarket matrix coordinate {self.field} {self.symmetry}\n{n} {n} {sum(m.entries for m in written)}\n".encode())
        if self.overwrite:
            for old in _parts(system, inner):
                system.delete_file(old.path)
        for name in [m.name for m in written] + [head]:     # without the head the folder is no matrix yet
            system.move(posixpath.join(temporary, name), posixpath.join(inner, name))
        system.delete_dir(temporary)

    def abort(self, messages: list[Written | None]) -> None:
        system, _, temporary = self._folder()
        if system.get_file_info(temporary).type == fs.FileType.Directory:
            system.delete_dir(temporary)


class MatrixMarketSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MatrixMarketReader:
        return MatrixMarketReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> MatrixMarketWriter:
        if not {"r", "c", "v"} <= set(schema.names):
            raise MatrixMarketError("columns r, c and v are required")
        return MatrixMarketWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make ``mtx`` known to a session and let Python sources take filters."""
    spark.dataSource.register(MatrixMarketSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- matrices ----------------------------------------------------------------------------------

def read_matrix_market(spark: SparkSession, path: str) -> Matrix:
    """The matrix of a file or folder; its text is read once, and staged as Parquet for all that follows."""
    register(spark)
    header = read_header(path)
    source = spark.read.format("mtx").option("found_header", json.dumps(asdict(header))).option("mirror", "false")
    try:
        entries = stage(source.load(path))
    except PySparkException as error:
        if "MatrixMarketError" in str(error):
            raise MatrixMarketError("invalid Matrix Market entry") from error
        raise
    found = entries.count()
    if found != header.entries:
        raise MatrixMarketError("truncated matrix" if found < header.entries else "more entries than declared")
    return Matrix(canonical(mirrored(entries, header.sign) if header.sign else entries), header.n)


def write_matrix_market(matrix: Matrix, path: str, symmetry: str = "general", field: str = "real", compression: str = "none") -> None:
    """Write a matrix as a folder of parts; for a symmetric form one triangle, after a check that the other one mirrors it."""
    register(matrix.entries.sparkSession)
    entries = matrix.entries.select("r", "c", "v")
    if symmetry != "general":
        sign = -1 if symmetry == "skew-symmetric" else 1
        upper = F.col("r") < F.col("c")
        pairs = entries.groupBy(F.greatest("r", "c").alias("r"), F.least("r", "c").alias("c")).agg(
            F.sum(F.when(upper, F.col("v") * sign)).alias("u"), F.sum(F.when(~upper, F.col("v"))).alias("v"))
        wrong = (F.col("r") != F.col("c")) & ~F.col("u").eqNullSafe(F.col("v"))
        if sign < 0:
            wrong = wrong | ((F.col("r") == F.col("c")) & (F.col("v") != 0))
        if pairs.filter(wrong).limit(1).count():
            raise MatrixMarketError(f"the matrix is not {symmetry}")
        entries = entries.filter(F.col("r") > F.col("c") if sign < 0 else ~upper)
    entries.write.format("mtx").option("n", matrix.n).option("symmetry", symmetry).option("field", field).option(
        "compression", compression).mode("append").save(path)
