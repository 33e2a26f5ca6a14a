"""Detection of periodic runs of words: suffix automaton with link-cut access.

The words of a stretch are appended one by one. The link tree of the suffix automaton holds all
their substrings; the path from the root to the state of a prefix holds the suffixes of that
prefix, and every state on it has a colour, the place where its substrings ended last. States of
one colour form segments of the path. Appending word i accesses the path of its prefix in a
link-cut forest whose preferred paths are these segments: a segment of colour e whose longest
substring has L words tells that the stretches ending at i and at e have exactly L words in
common. With p = i - e <= L the last 2 p words are a square, and its period p is the smallest (a
smaller one would show a later colour). The run of that square begins at e - L + 1, and it ends at
the last i that reports the same begin and period. The access recolours the whole path to i.

The automaton is built over the stretch before its words are replayed: the states it has
beyond those of a growing automaton split segments at no other length, as the common suffix of
two prefixes is a state of the whole as well. Segments are amortised O(log n) per word.

Stretches. A run of period q and length n >= max(LEAST, 3 q) lies in a stretch of words that are all
covered by windows of WINDOW words which occur again within a third of the stretch: a window of
the run recurs q words before or after it, inside the run, since n >= q + WINDOW. Windows are
compared by hashes (a clash only lengthens a stretch), and words outside such stretches, most of
ordinary text, are in no run and never reach the automaton. A stretch holds each of its runs
whole, with the words that end them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 24                # words of the shortest run
PERIODS = 3               # least exponent
WINDOW = 8                # words of a window; LEAST >= WINDOW * PERIODS / (PERIODS - 1) and PERIODS >= 2 are needed
PRUNINGS = 6              # rounds that shorten the stretches; stretches left too long only cost time
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def link_tree(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of the words: link and length of each state, and the state of each prefix.

    State 0 is nil, state 1 the root.
    """
    link, length, steps, prefixes = [0, 0], [0, 0], [{}, {}], []
    last = 1
    for w in words:
        own = len(link)
        link.append(1)
        length.append(length[last] + 1)
        steps.append({})
        at = last
        while at and w not in steps[at]:
            steps[at][w] = own
            at = link[at]
        if at:
            to = steps[at][w]
            if length[at] + 1 == length[to]:
                link[own] = to
            else:
                clone = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                steps.append(dict(steps[to]))
                while at and steps[at].get(w) == to:
                    steps[at][w] = clone
                    at = link[at]
                link[to] = link[own] = clone
        prefixes.append(own)
        last = own
    return link, length, prefixes


class Forest:
    """Link-cut forest over a fixed tree; the states of one preferred path share one colour.

    Each preferred path is a splay tree in the order of depth, with its colour at the splay root.
    ``up`` is the splay parent, or at a splay root the tree parent of its topmost state.
    """

    def __init__(self, link: list[int]):
        self.up, self.colour = list(link), [0] * len(link)
        self.upper, self.lower = [0] * len(link), [0] * len(link)      # splay children: nearer to the root, deeper

    def _rotate(self, x: int) -> None:
        up, upper, lower = self.up, self.upper, self.lower
        y = up[x]
        z = up[y]
        if upper[z] == y:
            upper[z] = x
        elif lower[z] == y:
            lower[z] = x
        if upper[y] == x:
            child = upper[y] = lower[x]
            lower[x] = y
        else:
            child = lower[y] = upper[x]
            upper[x] = y
        if child:
            up[child] = y
        up[y] = x
        up[x] = z

    def _splay(self, x: int) -> int:
        """Make x the root of its splay tree; the colour of its path."""
        up, upper, lower = self.up, self.upper, self.lower
        while True:
            y = up[x]
            if not y or (upper[y] != x and lower[y] != x):
                return self.colour[x]
            z = up[y]
            root = y
            if z and (upper[z] == y or lower[z] == y):
                root = z
                self._rotate(y if (upper[z] == y) == (upper[y] == x) else x)
            self.colour[x] = self.colour[root]       # counts if it was the root of the splay tree
            self._rotate(x)

    def access(self, x: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from x to the root; (old colour, deepest state) of its segments, deepest first."""
        out, below, own = [], 0, self.colour
        while x:
            old = self._splay(x)
            cut = self.lower[x]
            if cut:
                own[cut] = old
            self.lower[x] = below
            if old:
                out.append((old, x))
            below = x
            x = self.up[x]
        own[below] = colour
        return out


def runs_of(words: list, least: int = LEAST, periods: int = PERIODS) -> dict[tuple[int, int], int]:
    """(start, period) -> length of the maximal runs of at least ``max(least, periods * period)`` words."""
    link, length, prefixes = link_tree(words)
    forest = Forest(link)
    access = forest.access
    found: dict[tuple[int, int], int] = {}
    for i, state in enumerate(prefixes, 1):
        for end, deepest in access(state, i):
            period, common = i - end, length[deepest]
            if period <= common:
                size = common + period              # from the begin of the run to word i
                if size >= least and size >= periods * period:
                    found[(end - common, period)] = size
    return found


def _stretches(ids: np.ndarray, least: int, periods: int) -> list[tuple[int, int]]:
    """Half-open stretches of words that may hold runs; see the module."""
    n = len(ids)
    if n < least:
        return []
    values = (ids.astype(np.uint64) + np.uint64(1)) * _MULTIPLIER
    count = n - WINDOW + 1
    hashes = np.zeros(count, np.uint64)
    for k in range(WINDOW):
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + values[k:k + count]
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    far = np.iinfo(np.int64).max
    gap = np.full(count, far)                       # distance to the nearest equal window
    step = np.where(same, order[1:] - order[:-1], far)
    gap[order[1:]] = step
    gap[order[:-1]] = np.minimum(gap[order[:-1]], step)
    live = gap < far
    for last in (*[False] * (PRUNINGS - 1), True):
        # stretches covered by live windows, and windows that recur within a third of theirs
        covered = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(live)
        covered[at] += 1
        covered[at + WINDOW] -= 1
        inside = np.concatenate(([0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]))
        edges = np.diff(inside)
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        sizes = ends - begins
        own = sizes[np.searchsorted(begins, at, side="right") - 1] if len(at) else at
        keep = (own >= least) & (gap[at] * periods <= own)
        if last or keep.all():
            return list(zip(begins.tolist(), ends.tolist()))
        live[at[~keep]] = False


def find_runs(words: list, least: int = LEAST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start, then period."""
    if len(words) < least:
        return []
    if least < WINDOW * periods / (periods - 1):
        raise ValueError("runs this short need a smaller WINDOW")
    numbers: dict = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    found = []
    for begin, end in _stretches(ids, least, periods):
        found += [(begin + start, size, period) for (start, period), size in runs_of(ids[begin:end].tolist(), least, periods).items()]
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside the repetitions: of each run the first period stays, if no other run takes it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone[:-1]) == 0
    return [w for w, stays in zip(words, kept.tolist()) if stays]


def periodic_runs(docs: DataFrame, prepare: Callable[[int | None, list], list] | None = None,
                  least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs array<struct<start, length, period>>, collapsed``.

    Words are runs of bytes other than ASCII white space, numbered from 0; ``collapsed`` is the
    text of the words that stay, joined by one space. ``prepare`` may change the words of a
    document first, given its doc_id. Null and empty texts have no words and no runs; null doc_ids stay null;
    repeated rows are judged one by one. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                counts, flat, ends, texts = [], [], [0], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    words = (text or b"").split()
                    if prepare is not None:
                        words = prepare(doc_id, words)
                    runs = find_runs(words, least, periods)
                    counts.append(len(words))
                    flat += runs
                    ends.append(len(flat))
                    texts.append(b" ".join(collapsed(words, runs)))
                fields = [pa.array([r[i] for r in flat], pa.int64()) for i in range(3)]
                runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), runs, pa.array(texts, pa.binary()).cast(pa.string())],
                                                 names=["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_repetition(doc_id: int | None, words: list) -> list:
    """The words of about every tenth document, from some word on, turned into a repetition of their own."""
    n = len(words)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[:n - a]


def digests(docs: DataFrame) -> DataFrame:
    """Runs of the documents after ``with_repetition``, the strongest of them, and digests of runs and remaining words."""
    rows = periodic_runs(docs, with_repetition)
    # exponents are compared exactly, by cross products
    better = lambda x, y: (y["length"] * x["period"] > x["length"] * y["period"]) | (
        (y["length"] * x["period"] == x["length"] * y["period"]) & (F.struct(y["start"], y["period"]) < F.struct(x["start"], x["period"])))
    best = F.aggregate("runs", F.element_at("runs", 1), lambda x, y: F.when(better(x, y), y).otherwise(x))
    rows = rows.withColumn("best", F.when(F.size("runs") > 0, best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
