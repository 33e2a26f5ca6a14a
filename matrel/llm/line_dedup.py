"""Line dedup by a segment-partition edit join.

Lines are normalised (A-Z lowered, white space collapsed); two texts are linked when their edit
distance is at most ``DISTANCE``. A line is split into DISTANCE + 1 segments, so a linked line
holds at least one of them unchanged, at nearly the same place. Segments are index entries under
(length, segment number, text); a line probes the entries of every length from its own down to
DISTANCE less, with the substrings that can be such a segment if all edits left of it and right
of it fit the limit. Pairs that meet, and whose counts of characters allow a link, are verified by
banded bit-parallel edit distance.

Lines shorter than ``MIN_CHARS`` take no part. Of the lines of one class (linked over any number
of steps) the first in the order of doc_id and place stays. A proven copy keeps the lines it has
from the document it copies, for the document dedup to judge: without all other repeated lines, the
two are linked at the near-dedup limit on their full shingle sets, and the other one is no such copy
itself. Every other repeated line goes. With a ``copy_share`` a document that would lose more than
that share of its words is left whole instead; queries and pipeline do not use it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import attach, text_key, without_lines
from matrel.llm.components import components
from matrel.llm.near_dedup import Shingler, confirmed, list_array, mix64
from matrel.session import scratch, stage

DISTANCE = 2
MIN_CHARS = 20
COPY_SHARE = 0.5
BROADCAST_KEYS = 1_000_000      # 8-byte keys sent to all tasks; more are joined by a shuffle
TEXT_BLOCK = 1 << 18            # characters whose segments are hashed together
LIST_KEYS = 1 << 19             # keys that a task holds before it writes them out as lists
_BASE = 0x9E3779B97F4A7C15      # odd, so that it has an inverse
_WORD = (1 << 64) - 1


def segments(length: int, limit: int) -> list[tuple[int, int]]:
    """(start, size) of limit + 1 segments of nearly equal size, the longer ones last."""
    base, longer = divmod(length, limit + 1)
    sizes = [base + (i > limit - longer) for i in range(limit + 1)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def probes(length: int, limit: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line of this length looks up."""
    out = []
    for shorter in range(max(0, length - limit), length + 1):
        more = length - shorter
        for i, (start, size) in enumerate(segments(shorter, limit)):
            low = max(start - i, start + more - (limit - i), 0)
            high = min(start + i, start + more + (limit - i), length - size)
            out += [(shorter, i, at, size) for at in range(low, high + 1)]
    return out


def within(a: str, b: str, limit: int) -> bool:
    """Whether the edit distance is at most ``limit`` (up to 31), on a diagonal band of one machine word."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return False
    first = 0
    while first < len(b) and a[first] == b[first]:
        first += 1
    last = 0
    while last < len(b) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first:len(a) - last], b[first:len(b) - last]
    if len(a) <= limit:
        return True
    if not b:
        return False
    # bit 63 of the band is the row ``limit`` below the diagonal; the score follows that diagonal,
    # and the last row once it is reached
    rows: dict[str, int] = {}
    for i, ch in enumerate(a):
        rows[ch] = rows.get(ch, 0) | 1 << i
    up, down, score, last_row = (_WORD << (63 - limit)) & _WORD, 0, limit, 62
    for j, ch in enumerate(b):
        shift = j + limit - 63
        hit = rows.get(ch, 0)
        hit = (hit >> shift if shift >= 0 else hit << -shift) & _WORD
        keep = ((((hit & up) + up) ^ up) | hit | down) & _WORD
        grow = (down | ~(keep | up)) & _WORD
        fall = keep & up
        if j < len(a) - limit:
            score += not keep >> 63
        else:
            score += (grow >> last_row & 1) - (fall >> last_row & 1)
            last_row -= 1
        up = (fall | ~((keep >> 1) | grow)) & _WORD
        down = (keep >> 1) & grow
        if score > 2 * limit + len(b) - len(a) + limit:
            return False
    return score <= limit


def _normals(text: bytes | None) -> Iterator[bytes]:
    """The normalised lines of a text, in order. A text without runs of blanks needs no look at its words."""
    text = (text or b"").lower()
    if any(x in text for x in (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")):
        return (b" ".join(line.split()) for line in text.split(b"\n"))
    return (line.strip(b" ") for line in text.split(b"\n"))


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """Per document its words and its eligible lines, ``lines (place, id, more, words)``: two hashes of 64 bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                totals, places, ids, more, counts, ends = [], [], [], [], [], [0]
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    total = 0
                    for place, normal in enumerate(_normals(text)):
                        words = normal.count(b" ") + 1 if normal else 0
                        total += words
                        if len(normal) >= min_chars and len(normal.decode()) >= min_chars:
                            places.append(place)
                            ids.append(xxhash.xxh3_64_intdigest(normal))
                            more.append(xxhash.xxh64_intdigest(normal))
                            counts.append(words)
                    totals.append(total)
                    ends.append(len(ids))
                lines = pa.StructArray.from_arrays(
                    [pa.array(places, pa.int32()), pa.array(np.array(ids, np.uint64).view(np.int64)),
                     pa.array(np.array(more, np.uint64).view(np.int64)), pa.array(counts, pa.int64())], names=["place", "id", "more", "words"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(totals, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)],
                    names=["doc_id", "text_key", "n_words", "lines"])

    rows = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, n_words long, "
                                "lines array<struct<place: int, id: bigint, more: bigint, words: bigint>>")


def _normal_lines(texts: list[bytes | None], min_chars: int, seen: set) -> Iterator[tuple[int, str]]:
    """Eligible lines not met in this task before, as (id, text)."""
    for text in texts:
        for normal in _normals(text):
            if len(normal) >= min_chars:
                id_ = xxhash.xxh3_64_intdigest(normal)
                if id_ not in seen:
                    seen.add(id_)
                    decoded = normal.decode()
                    if len(decoded) >= min_chars:
                        yield id_, decoded
    if len(seen) > 300_000:
        seen.clear()


def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the segment hashes, from 0 on, and their inverses modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(count, base, np.uint64)
        steps[:1] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Segmenter:
    """Keys of the index entries and lookups of lines: polynomial hashes of substrings, from sums over the whole text.

    Equal substrings of any two lines have equal hashes, whatever their places; a chance collision
    only makes a pair that the verification drops.
    """

    def __init__(self, limit: int):
        self.limit = limit
        self.plans: dict[int, np.ndarray] = {}
        self.codes = mix64(np.arange(1, 1 + (1 << 16), dtype=np.uint64))
        self.powers = _powers(TEXT_BLOCK + 1)

    def _plan(self, n: int) -> np.ndarray:
        """Starts, ends and hashed seeds of the lookups of a line of ``n`` characters, and which of them are its index entries."""
        plan = self.plans.get(n)
        if plan is None:
            lookups = probes(n, self.limit)
            entries = {(n, i, start, size) for i, (start, size) in enumerate(segments(n, self.limit))}
            seeds = mix64(np.array([length * (self.limit + 1) + i for length, i, _, _ in lookups], np.uint64))
            plan = np.array([[at for _, _, at, _ in lookups], [at + size for _, _, at, size in lookups], seeds.view(np.int64),
                             [p in entries for p in lookups]])
            if len(self.plans) < 20_000:
                self.plans[n] = plan
        return plan

    def __call__(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of all lines, whether each is that of an index entry as well, and the number of keys of each line."""
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
        powers, inverses = self.powers if len(codes) <= TEXT_BLOCK else _powers(len(codes) + 1)
        values = self.codes[np.minimum(codes, 0xFFFF)]
        far = codes >= 0xFFFF
        if far.any():
            values[far] = mix64(codes[far].astype(np.uint64) + np.uint64(1))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(values * powers[:len(codes)], out=sums[1:])
        lengths = [len(line) for line in lines]
        plans = [self._plan(n) for n in lengths]
        counts = np.array([plan.shape[1] for plan in plans])
        first = np.repeat(np.cumsum(lengths) - lengths, counts)
        begin, end, seeds, entries = np.concatenate(plans, axis=1)
        begin, end = begin + first, end + first
        return mix64((sums[end] - sums[begin]) * inverses[begin] + seeds.view(np.uint64)), entries.astype(bool), counts


class Listed:
    """Tells which keys are among ``keys`` (sorted); few others come as far as the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.marks = np.zeros(1 << 22, bool)
        self.marks[keys >> np.uint64(42)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places of the listed ones."""
        at = np.flatnonzero(self.marks[keys >> np.uint64(42)])
        if len(at):
            found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            at = at[self.keys[found] == keys[at]]
        return at


def _segment_rows(docs: DataFrame, limit: int, min_chars: int, buckets: int = 0) -> DataFrame:
    """``key, id, entry``: lookups of the lines. Those of a line's own segments at their own places are its index entries as well.

    With ``buckets`` they come as lists of one bucket of the keys each, ``bucket, keys, ids``: 8 bytes a key, its lowest bit
    telling the entries, and 8 bytes an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        segmenter = Segmenter(limit)
        held, size = [], 0

        def lists() -> pa.RecordBatch:
            keys, ids = (np.concatenate([x[i] for x in held]) for i in range(2))
            bucket = _bucket(keys, buckets)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            offsets = pa.py_buffer((np.append(starts, len(keys)) * 8).astype(np.int32))
            binary = lambda x: pa.Array.from_buffers(pa.binary(), len(starts), [None, offsets, pa.py_buffer(x[order])])
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), binary(keys), binary(ids)], names=["bucket", "keys", "ids"])

        for ids, lines in _line_blocks(batches, min_chars, seen):
            keys, entries, counts = segmenter(lines)
            ids = np.repeat(np.array(ids, np.uint64), counts)
            if not buckets:
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids.view(np.int64)), pa.array(entries)], names=["key", "id", "entry"])
                continue
            held.append(((keys | np.uint64(1)) ^ (~entries).astype(np.uint64), ids))
            size += len(keys)
            if size >= LIST_KEYS:
                yield lists()
                held, size = [], 0
        if held:
            yield lists()

    kind = "bucket int, keys binary, ids binary" if buckets else "key long, id long, entry boolean"
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int16 if buckets < 1 << 15 else np.int64)


def _line_blocks(batches: Iterator[pa.RecordBatch], min_chars: int, seen: set) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the eligible lines of a task, in blocks of bounded text."""
    for whole in batches:
        ids, lines, size = [], [], 0
        for begin in range(0, whole.num_rows, 128):
            batch = whole.slice(begin, 128)
            for id_, line in _normal_lines(batch.column(0).cast(pa.binary()).to_pylist(), min_chars, seen):
                if lines and size + len(line) > TEXT_BLOCK:
                    yield ids, lines
                    ids, lines, size = [], [], 0
                ids.append(id_)
                lines.append(line)
                size += len(line)
        if lines:
            yield ids, lines


def _met(table: pa.Table) -> pa.Table:
    """``key, id, entry`` of the keys in one bucket under which an index entry and a lookup of different lines meet, each line once a key."""
    flat = lambda name: np.frombuffer(b"".join(table.column(name).to_pylist()), np.uint64)
    words, ids = flat("keys"), flat("ids")
    keys = words >> np.uint64(1)
    ordered = np.sort(keys)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(again):
        at = np.minimum(np.searchsorted(again, keys), len(again) - 1)
        some = again[at] == keys
        words, ids = words[some], ids[some]
        order = np.lexsort((~words, ids, words >> np.uint64(1)))          # an entry before the other rows of its line
        words, ids = words[order], ids[order]
        keys = words >> np.uint64(1)
        first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])))
        words, ids, keys = words[first], ids[first], keys[first]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        entry = (words & np.uint64(1)).astype(bool)
        sizes = np.diff(np.append(starts, len(keys)))
        live = np.repeat((sizes > 1) & np.logical_or.reduceat(entry, starts), sizes)
        keys, ids, entry = keys[live], ids[live], entry[live]
    else:
        keys, ids, entry = keys[:0], ids[:0], np.empty(0, bool)
    return pa.table({"key": keys.view(np.int64), "id": ids.view(np.int64), "entry": entry})


def parities(line: str) -> tuple[int, int]:
    """Two signed 64-bit words: parities of the counts of characters and of character pairs, each in 64 classes.

    An edit changes at most two counts of characters and four of pairs, so lines within a
    distance of d differ in at most 2 d and 4 d bits.
    """
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    for values in (codes, codes[:-1] * np.uint64(0x1000003) + codes[1:]):
        classes = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58)
        odd = np.bincount(classes.astype(np.int64), minlength=64) & 1
        out.append(int(np.packbits(odd.astype(bool)).view(">i8")[0]))
    return out[0], out[1]


def _named_texts(docs: DataFrame, min_chars: int, named: Broadcast | None) -> DataFrame:
    """``id, line`` of the eligible lines, of all or of those whose ids (sorted) are named; each once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = None if named is None else Listed(named.value)
        for ids, lines in _line_blocks(batches, min_chars, set()):
            ids = np.array(ids, np.uint64)
            if listed is not None:
                at = listed(ids)
                ids, lines = ids[at], [lines[i] for i in at.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(lines, pa.string())], names=["id", "line"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "id long, line string")


def _line_texts(docs: DataFrame, min_chars: int) -> DataFrame:
    return _named_texts(docs, min_chars, None)


def _with_parities(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [parities(line) for line in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([w[0] for w in words], pa.int64()), pa.array([w[1] for w in words], pa.int64())],
                names=["id", "line", "chars", "pairs"])

    return lines.mapInArrow(run, "id long, line string, chars long, pairs long")


def _verified(pairs: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            yield batch.filter(pa.array([within(x, y, limit) for x, y in zip(a, b)], pa.bool_())).select(["a", "b"])

    return pairs.select("a", "b", "la", "lb").mapInArrow(run, "a long, b long")


def _met_lines(docs: DataFrame, limit: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """``key, id, entry`` of the live keys, each line once a key, and ``id, line`` of their lines.

    Keys meet in buckets, sorted by numpy. Lines that are counted to be few are named to the tasks that cut the lines, so
    that no other line leaves these; else they are joined.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stage(_segment_rows(docs, limit, min_chars, buckets).groupBy("bucket").applyInArrow(_met, "key long, id long, entry boolean"))
    ids = stage(rows.select("id").distinct())
    if ids.count() <= BROADCAST_KEYS:
        wanted = np.sort(ids.toArrow().column("id").to_numpy().view(np.uint64))
        lines = _named_texts(docs, min_chars, docs.sparkSession.sparkContext.broadcast(wanted))
    else:
        lines = _line_texts(docs, min_chars).join(ids, "id", "left_semi")
    return rows, lines.groupBy("id").agg(F.min("line").alias("line"))


def line_links(docs: DataFrame, limit: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs ``a, b`` (line ids) of different normalised lines within the edit distance, each once."""
    rows, lines = _met_lines(docs, limit, min_chars)
    lines = stage(_with_parities(lines))
    rows = rows.join(lines.drop("line"), "id")
    entries = rows.filter("entry").select("key", F.col("id").alias("x"), F.col("chars").alias("cx"), F.col("pairs").alias("px"))
    lookups = rows.select("key", F.col("id").alias("y"), F.col("chars").alias("cy"), F.col("pairs").alias("py"))
    # parities rule out most pairs of long lines that share a segment and no more, inside the join
    near = (F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= 2 * limit) & (F.bit_count(F.col("px").bitwiseXOR(F.col("py"))) <= 4 * limit)
    lookups = lookups.withColumnRenamed("key", "key_2")
    pairs = entries.join(lookups, (F.col("key") == F.col("key_2")) & (F.col("x") != F.col("y")) & near)
    pairs = stage(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    texts = lines.select("id", "line")
    with_texts = pairs.join(texts.withColumnsRenamed({"id": "a", "line": "la"}), "a").join(texts.withColumnsRenamed({"id": "b", "line": "lb"}), "b")
    return _verified(with_texts, limit)


def _copied(marked: DataFrame) -> DataFrame:
    """``row, leader, keeps``: the document that holds the first lines of most words of a row, and the places of these.

    Of the repetitions of one line inside the row the first is listed. Rows with less than half
    of what would be left from that document are not listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, leaders, keeps = [], [], []
            for row, again, left in zip(*(batch.column(i).to_pylist() for i in range(3))):
                seen, sums, own = set(), {}, {}
                for x in sorted(again, key=lambda x: x["place"]):
                    line = (x["leader"], x["at"])
                    if x["leader"] != row and line not in seen:
                        seen.add(line)
                        sums[x["leader"]] = sums.get(x["leader"], 0) + x["words"]
                        own.setdefault(x["leader"], []).append(x["place"])
                if sums:
                    best = max(sums, key=lambda k: (sums[k], -k))
                    if sums[best] >= left:
                        rows.append(row)
                        leaders.append(best)
                        keeps.append(own[best])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), pa.array(leaders, pa.int64()), pa.array(keeps, pa.list_(pa.int32()))], names=["row", "leader", "keeps"])

    return marked.select("row", "again", "left").mapInArrow(run, "row long, leader long, keeps array<int>")


def _left_sets(texts: DataFrame) -> DataFrame:
    """``node, shingles`` of ``node, text, places``: the shingles of a text without the lines at these places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                left = []
                for text, gone in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    gone = set(gone or ())
                    left.append(shingler(b"\n".join(x for i, x in enumerate((text or b"").split(b"\n")) if i not in gone)))
                yield pa.RecordBatch.from_arrays([batch.column(0), list_array(left)], names=["node", "shingles"])

    return texts.select("node", "text", "places").mapInArrow(run, "node long, shingles array<long>")


def _proven(docs: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``row, keeps``: proven copies, and the places of the lines they keep from the document they copy."""
    # repeated rows of one doc_id and text are judged as the first of them
    firsts = rows.groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0).cast("long"))
    found = marked.join(firsts.join(rows.select("row", "n_words"), "row"), "row").withColumn("left", left)
    copied = stage(_copied(found))
    copies = copied.select((F.col("row") * 2 + 1).alias("node"), "row", "keeps")
    leaders = copied.select((F.col("leader") * 2).alias("node"), F.col("leader").alias("row"), F.lit(None).cast("array<int>").alias("keeps")).distinct()
    wanted = copies.unionByName(leaders).join(marked.select("row", "places"), "row", "left").join(firsts, "row").select(
        "node", "doc_id", "text_key", F.array_except("places", F.coalesce("keeps", F.array().cast("array<int>"))).alias("places"))
    wanted = stage(wanted.withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}))
    same = F.col("text_key").eqNullSafe(F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    texts = docs.select("doc_id", text_key().alias("text_key"), F.col("text").cast("string").alias("text"))
    keys = stage(wanted.select("_id", "_key").distinct())
    if keys.count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    texts = texts.join(keys, same, "left_semi").groupBy("doc_id", "text_key").agg(F.any_value("text").alias("text"))
    sets = stage(_left_sets(wanted.join(texts, same)))
    pairs = copied.select((F.col("leader") * 2).alias("a"), (F.col("row") * 2 + 1).alias("b"))
    linked = stage(confirmed(pairs, sets))
    a, b = F.expr("a div 2").alias("leader"), F.expr("(b - 1) div 2").alias("row")
    linked = stage(linked.select(a, b))
    firm = linked.join(linked.select(F.col("row").alias("leader")), "leader", "left_anti").select("row")
    return copied.join(firm, "row").select("row", "keeps")


def _marked(docs: DataFrame, rows: DataFrame, limit: int, min_chars: int) -> DataFrame:
    """Rows with lines of a class of two or more: ``row, n_links, n_repeated, gone, places, again``."""
    links = stage(line_links(docs, limit, min_chars))
    degrees = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    near = degrees.join(components(links).withColumnRenamed("node", "id"), "id", "left").select(
        "id", "degree", F.coalesce("component", "id").alias("class"))
    lines = rows.select("row", "doc_id", F.explode("lines").alias("line")).select("row", "doc_id", "line.*")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row", "place")
    distinct = lines.groupBy("id", "more").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    distinct = stage(distinct.join(near, "id", "left"))
    # a text without links is a class of its own, kept apart by both hashes
    class_ = F.struct(F.coalesce("class", "id").alias("c"), F.when(F.col("class").isNull(), F.col("more")).otherwise(F.lit(0)).alias("m"))
    distinct = distinct.withColumn("class", class_)
    classes = distinct.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("in_class")).filter("in_class > 1")
    repeated = distinct.drop("first").join(classes, "class").select(
        F.struct("id", "more").alias("line"), "n", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"),
        F.struct("first.row", "first.place").alias("first"))
    repeated = stage(repeated)
    lines = lines.select("row", "place", "words", F.struct("id", "more").alias("line"))
    marked = attach(lines, repeated, "line", "n", rows.count()).filter("first IS NOT NULL")
    again = ~F.struct("row", "place").eqNullSafe(F.struct("first.row", "first.place"))
    return marked.groupBy("row").agg(
        F.sum("degree").alias("n_links"), F.count_if(again).alias("n_repeated"), F.sum(F.when(again, F.col("words"))).alias("gone"),
        F.collect_list(F.when(again, F.col("place"))).alias("places"),
        F.collect_list(F.when(again, F.struct("place", "words", F.col("first.row").alias("leader"), F.col("first.place").alias("at")))).alias("again"))


def repeated_lines(docs: DataFrame, limit: int = DISTANCE, min_chars: int = MIN_CHARS, copy_share: float | None = COPY_SHARE) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_links, n_repeated, whole, places, text_key``.

    ``n_lines`` counts the eligible lines, ``n_links`` the links of their texts to different
    texts, ``n_repeated`` the lines that are not the first of their class; ``places`` lists
    those to remove, and is null if there are none. ``whole`` tells a document that keeps repeated
    lines: without a ``copy_share`` a proven copy, else a document left whole by its share. Null and
    empty texts have no lines. Null doc_ids come last in the order; repeated rows are told
    apart by their place in the table. Other columns are ignored; an empty table gives an
    empty result.
    """
    rows = stage(_line_rows(docs, min_chars).withColumn("row", F.monotonically_increasing_id()))
    with scratch(docs.sparkSession) as keep:
        marked = keep(stage(_marked(docs, rows, limit, min_chars)))
    if copy_share is None:
        return _without_copies(docs, rows, marked)
    rows = rows.select("row", "doc_id", "text_key", "n_words", F.size("lines").cast("long").alias("n_lines")).join(marked, "row", "left")
    none = F.lit(0).cast("long")
    whole = F.coalesce(F.col("gone") > F.col("n_words") * copy_share, F.lit(False))
    return rows.select(
        "doc_id", "n_lines", F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_repeated", none).alias("n_repeated"),
        whole.alias("whole"), F.when(~whole & (F.col("n_repeated") > 0), F.array_sort("places")).alias("places"), "text_key")


def _without_copies(docs: DataFrame, rows: DataFrame, marked: DataFrame) -> DataFrame:
    """The result of ``repeated_lines`` with proven copies."""
    with scratch(docs.sparkSession) as keep:
        proven = keep(stage(_proven(docs, rows, marked)))
    marked = marked.join(proven, "row", "left")
    places = F.array_sort(F.array_except("places", F.coalesce("keeps", F.array().cast("array<int>"))))
    rows = rows.select("row", "doc_id", "text_key", F.size("lines").cast("long").alias("n_lines")).join(
        marked.select("row", "n_links", "n_repeated", F.col("keeps").isNotNull().alias("whole"), places.alias("places")), "row", "left")
    # a repeated row is a copy of the first one of its key, and is treated as that
    again = stage(rows.groupBy("doc_id", "text_key").agg(F.min("row").alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"))
    heads = again.join(rows.select(F.col("row").alias("head"), F.col("places").alias("head_places")), "head")
    heads = heads.select(F.struct("doc_id", "text_key").alias("key"), "head", "head_places", "copies")
    rows = attach(rows.withColumn("key", F.struct("doc_id", "text_key")), heads, "key", "copies", rows.count())
    is_copy = F.col("head").isNotNull() & (F.col("row") != F.col("head"))
    none, places = F.lit(0).cast("long"), F.when(is_copy, F.col("head_places")).otherwise(F.col("places"))
    return rows.select(
        "doc_id", "n_lines", F.coalesce("n_links", none).alias("n_links"), F.coalesce("n_repeated", none).alias("n_repeated"),
        (is_copy | F.coalesce("whole", F.lit(False))).alias("whole"), F.when(F.size(places) > 0, places).alias("places"), "text_key")


def dedup_lines(docs: DataFrame, copy_share: float | None = COPY_SHARE) -> DataFrame:
    """All documents without their repeated lines, with all columns of ``docs``."""
    with scratch(docs.sparkSession) as keep:
        removed = repeated_lines(docs, copy_share=copy_share).filter("places IS NOT NULL").select("doc_id", "text_key", "places")
        removed = keep(stage(removed.dropDuplicates(["doc_id", "text_key"])))
    return without_lines(docs, removed)
