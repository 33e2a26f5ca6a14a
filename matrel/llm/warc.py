"""WARC archives: a writer, and a sequential reader that keeps one piece of a record in memory.

Every record is one gzip member. Of the records with equal payloads the one with the largest id
is a ``response``, all others ``revisit`` it: their block is the HTTP head alone, which still
tells the length of the payload. Records are written by the tasks that hold them, into files below
the shared folder that are begun anew beyond a size; the table of written files lists those of
committed tasks only, so what a lost task attempt has left behind is never read.

The reader takes one file as a stream: members are inflated piece by piece, the head is read up
to its empty line, the block is framed by Content-Length and digested as it passes, and the end
of the member must meet the end of the record. What does not fit is told in ``problem``; after a
damaged member the reader cannot know where the next one begins, so that row is the last of its file.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import attach
from matrel.session import new_path, stage

FILE_BYTES = 256 << 20          # a file is closed beyond this compressed size
PIECE = 1 << 16                 # bytes read, and bytes inflated, at a time
MAX_HEAD = 1 << 20              # longest accepted record or HTTP head
LEAST_REVISIT = 0               # payloads smaller than this are never revisits
_END = b"\r\n\r\n"
_DIGEST = "sha1:"


class WarcError(ValueError):
    pass


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


# --- writing -----------------------------------------------------------------------------------

def _field(value: str) -> str:
    """A header value on one line: control characters and spaces are percent-encoded."""
    return quote(value, safe="".join(map(chr, range(33, 127))))


def record_bytes(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, not yet compressed. A revisit holds the HTTP head of its payload only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if kind == "response" else head
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), ("WARC-Target-URI", _field(uri or "")),
        ("WARC-Payload-Digest", _DIGEST + base32_sha1(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", _DIGEST + base32_sha1(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + _END


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def classified(records: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records ``record_id, uri, payload`` with their ``kind`` and ``refers_to`` (an id).

    Payloads are equal when length and SHA-256 are. The response is the record with the largest
    id, or all records that repeat that id; null ids are smaller than any, and where all ids of
    a payload are null, all its records are responses.
    """
    key = F.struct(F.sha2("payload", 256).alias("hash"), F.octet_length("payload").alias("bytes"))
    records = records.select("record_id", "uri", "payload").withColumn("same", key)
    large = F.octet_length("payload") >= least
    groups = records.filter(large).groupBy("same").agg(F.max("record_id").alias("largest"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = stage(groups)
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]     # payloads that occur once are in no group
    joined = attach(records, groups, "same", "copies", total)
    revisits = F.col("largest").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("largest"))
    return joined.select("record_id", "uri", "payload", F.when(revisits, "revisit").otherwise("response").alias("kind"),
                         F.when(revisits, F.col("largest")).alias("refers_to"))


def _urn(number: int | None) -> str:
    return f"urn:record:{'none' if number is None else number}"



def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``record_id long, uri string, payload binary, kind, refers_to``; returns the files, ``path, records, bytes``.

    Names hold a random part, so two attempts of one task never write the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        out = name = None
        done, records_in, size = [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((f"{folder.rstrip('/')}/{name}", records_in, size))
                out = None

        for batch in batches:
            for record_id, uri, payload, kind, refers_to in zip(*(batch.column(i) for i in range(5))):
                if out is None:
                    name, records_in, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(posixpath.join(base, name), compression=None)
                refers_to = refers_to.as_py()
                member = gzip_member(record_bytes(kind.as_py(), _urn(record_id.as_py()), uri.as_py(), date, payload.as_py() or b"",
                                                  None if refers_to is None else _urn(refers_to)))
                out.write(member)
                records_in += 1
                size += len(member)
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                                         names=["path", "records", "bytes"])

    ordered = records.select("record_id", "uri", "payload", "kind", "refers_to")
    return stage(ordered.mapInArrow(run, "path string, records long, bytes long"))


# --- reading -----------------------------------------------------------------------------------

class _Member:
    """One gzip member of a stream, inflated on demand; ``spare`` are bytes already read beyond it."""

    def __init__(self, stream, spare: bytes):
        self.stream, self.inflater = stream, zlib.decompressobj(31)
        self.waiting, self.ready, self.used = spare, b"", 0

    def _more(self) -> bytes:
        """At most PIECE further bytes, none at the end of the member."""
        while not self.inflater.eof:
            if not self.waiting:
                self.waiting = self.stream.read(PIECE)
                if not self.waiting:
                    raise WarcError("truncated member")
            before = len(self.waiting)
            try:
                data = self.inflater.decompress(self.waiting, PIECE)
            except zlib.error as error:
                raise WarcError("damaged member") from error
            rest = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            self.used += before - len(rest)
            self.waiting = rest
            if data:
                return data
        return b""

    def until(self, mark: bytes, limit: int) -> bytes:
        """The bytes up to and including ``mark``."""
        found = self.ready.find(mark)
        while found < 0:
            if len(self.ready) > limit:
                raise WarcError("head too long")
            begin, data = max(0, len(self.ready) - len(mark)), self._more()
            if not data:
                raise WarcError("head without an end")
            self.ready += data
            found = self.ready.find(mark, begin)
        out, self.ready = self.ready[:found + len(mark)], self.ready[found + len(mark):]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in pieces."""
        while size:
            data = self.ready or self._more()
            if not data:
                raise WarcError("block shorter than its length")
            self.ready = data[size:]
            data = data[:size]
            size -= len(data)
            yield data

    def finish(self) -> bytes:
        """Check that the record ends here with its two line ends; the bytes read beyond the member."""
        while len(self.ready) <= len(_END):
            data = self._more()
            if not data:
                break
            self.ready += data
        if self.ready != _END:
            raise WarcError("record longer than its length")
        return self.waiting


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise WarcError("no WARC record")
    pairs = (line.partition(":") for line in lines[1:] if line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _length(fields: dict[str, str]) -> int:
    value = fields.get("content-length", "")
    if not value.isascii() or not value.isdigit():
        raise WarcError("no Content-Length")
    return int(value)


def _read_one(member: _Member, keep_payload: bool) -> dict:
    """One record; digests are taken while the block passes."""
    fields = _fields(member.until(_END, MAX_HEAD))
    row = {"record_id": fields.get("warc-record-id"), "kind": fields.get("warc-type"), "uri": fields.get("warc-target-uri"),
           "date": fields.get("warc-date"), "refers_to": fields.get("warc-refers-to"), "problem": None, "payload": None}
    block, payload = hashlib.sha1(), hashlib.sha1()
    http = fields.get("content-type", "").startswith("application/http")
    head, in_head, size, kept = b"", http, 0, []
    for data in member.take(_length(fields)):
        block.update(data)
        if in_head:
            head += data
            end = head.find(_END)
            if end < 0:
                if len(head) > MAX_HEAD:
                    raise WarcError("head too long")
                continue
            head, data, in_head = head[:end], head[end + len(_END):], False
        payload.update(data)
        size += len(data)
        if keep_payload:
            kept.append(data)
    if in_head:
        row["problem"] = "HTTP head without an end"
    stated = fields.get("warc-payload-digest", "").removeprefix(_DIGEST)
    if row["kind"] == "revisit":
        # the payload is that of another record: its length stands in the HTTP head
        told = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
        row["payload_bytes"], row["payload_digest"] = int(told[1]) if told else None, stated or None
        if size or not stated or not told or not row["refers_to"]:
            row["problem"] = row["problem"] or "incomplete revisit"
    else:
        row["payload_bytes"], row["payload_digest"] = size, base32_sha1(payload.digest())
        row["payload"] = b"".join(kept) if keep_payload else None
        if stated and stated != row["payload_digest"]:
            row["problem"] = row["problem"] or "payload digest differs"
    told = fields.get("warc-block-digest", "").removeprefix(_DIGEST)
    if told and told != base32_sha1(block.digest()):
        row["problem"] = row["problem"] or "block digest differs"
    return row


def read_stream(stream, keep_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order, with ``offset``, the place of their member in the file."""
    spare, offset = b"", 0
    while True:
        spare = spare or stream.read(PIECE)
        if not spare:
            return
        member = _Member(stream, spare)
        try:
            row = _read_one(member, keep_payload)
            spare = member.finish()
        except WarcError as error:
            yield {"offset": offset, "problem": str(error)}
            return
        yield {"offset": offset, **row}
        offset += member.used


RECORD = ("path string, offset long, record_id string, kind string, uri string, date string, refers_to string, "
          "payload_bytes long, payload_digest string, problem string")


def read_archives(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the archives named by ``path``, each file read by one task; ``payload`` on request."""
    names = [c.split()[0] for c in RECORD.split(", ")] + (["payload"] if keep_payload else [])
    types = {"offset": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], types.get(n, pa.string())) for n in names], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
                rows, held = [], 0
                with system.open_input_stream(name, compression=None) as stream:
                    for row in read_stream(stream, keep_payload):
                        rows.append({"path": path, **row})
                        held += len(row.get("payload") or b"")
                        if len(rows) == 4096 or held > PIECE * 256:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    paths = files.select("path")
    paths = paths.repartition(max(1, paths.count()), "path")
    return paths.mapInArrow(run, RECORD + (", payload binary" if keep_payload else ""))


def round_trip(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One row per page, read back from its archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``, ``problem``.

    Null html is an empty payload, a null url an empty target. Null page_ids stay null; rows that
    repeat a page_id and a payload are records of their own (see ``classified``). Other columns
    are ignored; an empty table gives an empty result.
    """
    records = pages.select(F.col("page_id").cast("long").alias("record_id"), F.col("url").cast("string").alias("uri"),
                           F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    files = write_archives(classified(records, least), new_path(pages.sparkSession, "warc"))
    number = lambda c: F.regexp_extract(c, r"^<urn:record:(-?\d+)>$", 1).try_cast("long")
    return read_archives(files).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        number("refers_to").alias("refers_to"), "problem")


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS largest FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
    list_aggregate([substr('{_BASE32}', CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT) + 1, 1)
                    FOR i IN range(32)], 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = largest OR largest IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = largest OR largest IS NULL THEN NULL ELSE largest END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM d
"""
