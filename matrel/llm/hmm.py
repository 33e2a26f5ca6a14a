"""Hidden Markov language model over word classes.

Tokens are words and one end token per document. The most frequent words and the end token are
symbols of their own; any other word, seen or not, falls into one of ``SPELLINGS`` classes by its
spelling, and a class shares its probability among its words by add-one counts, one place
being left for words not seen. The alphabet of the hidden model is thus bounded while the
word probabilities cover the whole vocabulary and sum to one.

Training: counts of words are summed over all training documents; then Baum-Welch passes
read all training symbols, every task sums the expected counts of its own rows, and a grouped
sum over tasks gives the next model. Documents are read in windows of ``WINDOW`` symbols for
training; scoring runs the scaled forward recursion over whole documents.

Only bounded tables reach the driver or all tasks: the ``SYMBOLS`` most frequent words, at
most ``KNOWN`` words with their counts, and the class totals. The counts of all other
words are looked up by a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.llm.common import Memo
from matrel.session import stage

STATES = 8
SYMBOLS = 4096          # words with a symbol of their own
SPELLINGS = 1024        # classes of the other words
KNOWN = 150_000         # words whose counts every task holds
WINDOW = 128
PASSES = 5
HELD_OUT = (7, 2)       # documents with crc32(doc_id) % 7 == 2 train nothing
END = 0                 # symbol of the end token
SEED = 7


def spelling(word: bytes) -> int:
    """Class of a word by its last two characters and whether it begins like a number."""
    tail = word.decode("utf-8", "replace").rstrip(".,;:!?|")[-2:]
    return zlib.crc32(tail.encode() + (b"#" if word[:1].isdigit() else b"")) % SPELLINGS


class Lexicon:
    """The broadcast words with their symbol, log10(count + 1) and log10 probability inside the class; class totals."""

    def __init__(self, symbols: dict[bytes, int], counts: dict[bytes, int], class_tokens: np.ndarray, class_words: np.ndarray):
        self.first = len(symbols) + 1                # symbols: end, own words, spelling classes
        self.size = self.first + SPELLINGS
        self.rest = np.log10(class_tokens + class_words + 1)
        self.rows = {word: row for row, word in enumerate(counts)}
        self.share = np.log10(np.fromiter(counts.values(), np.float64, len(counts)) + 1)
        own = np.fromiter((symbols.get(word, 0) for word in counts), np.int64, len(counts))
        kinds = np.fromiter((0 if symbols.get(word) else spelling(word) for word in counts), np.int64, len(counts))
        self.symbol = np.where(own > 0, own, self.first + kinds).astype(np.uint16)
        self.inside = np.where(own > 0, 0.0, self.share - self.rest[kinds])

    def encode(self, words: list[bytes], kinds: Memo) -> tuple[np.ndarray, float, float, int, Counter]:
        """Symbols, sums of both logarithms over the broadcast words, their number, and the other words.

        The counts of the others come by the join, and so does their share of the probability
        inside the class; only its denominator is taken here.
        """
        rows = np.fromiter(map(self.rows.get, words, repeat(-1)), np.int64, len(words))
        other = np.flatnonzero(rows < 0)
        if not len(other):
            return self.symbol[rows], float(self.share[rows].sum()), float(self.inside[rows].sum()), len(words), Counter()
        here = rows[rows >= 0]
        rare = [words[i] for i in other]
        kind = np.fromiter(map(kinds.__getitem__, rare), np.int64, len(rare))
        symbols = np.empty(len(words), np.uint16)
        symbols[rows >= 0] = self.symbol[here]
        symbols[other] = self.first + kind
        return symbols, float(self.share[here].sum()), float(self.inside[here].sum() - self.rest[kind].sum()), len(here), Counter(rare)


def _held_out(doc_id):
    of, rest = HELD_OUT
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(of)) == rest, F.lit(False))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word binary, n``: occurrences over all rows, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush():
            words = pa.array(list(counts), pa.binary())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                counts.update((text or b"").lower().split())
                if len(counts) > 300_000:
                    yield flush()
                    counts.clear()
        yield flush()

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _lexicon(vocabulary: DataFrame, documents: int) -> Lexicon:
    """The bounded part of the vocabulary, on the driver."""
    # count limit that at most KNOWN words reach, from a histogram with at most 64 * 16 bars
    bar = F.floor(F.log2("n") * 16)
    bars = vocabulary.groupBy(bar.alias("bar")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).collect()
    limit, room = None, KNOWN
    for row in sorted(bars, key=lambda r: -r["bar"]):
        room -= row["words"]
        if room < 0:
            break
        limit = row["least"]
    known = [] if limit is None else vocabulary.filter(F.col("n") >= limit).collect()
    counts = {bytes(r["word"]): r["n"] for r in known}
    frequent = sorted(counts, key=lambda w: (-counts[w], w))[:SYMBOLS]
    symbols = {w: i + 1 for i, w in enumerate(frequent)}

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, words = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if word not in symbols:
                    kind = spelling(word)
                    tokens[kind] += n
                    words[kind] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SPELLINGS)), pa.array(tokens), pa.array(words)], names=["kind", "tokens", "words"])

    rows = vocabulary.mapInArrow(classes, "kind long, tokens long, words long").groupBy("kind").agg(
        F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect()
    tokens, words = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in rows:
        tokens[r["kind"]], words[r["kind"]] = r["tokens"], r["words"]
    return Lexicon(symbols, counts, tokens, words)


def _encoded(docs: DataFrame, lexicon) -> DataFrame:
    """Symbols of every document as 16-bit values, its known sums, and the words left to the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kinds = lexicon.value.encode, Memo(spelling, 200_000)
        for whole in batches:
            for begin in range(0, whole.num_rows, 256):
                batch = whole.slice(begin, 256)
                out: list[list] = [[] for _ in range(5)]
                rare_words, rare_counts, ends = [], [], [0]
                for text in batch.column(2).cast(pa.binary()).to_pylist():
                    words = (text or b"").lower().split()
                    symbols, share, inside, known, rare = encode(words, kinds)
                    kinds.trim()
                    rare_words += rare
                    rare_counts += rare.values()
                    ends.append(len(rare_words))
                    values = (len(words), np.append(symbols, np.uint16(END)).tobytes(), share, inside, known)
                    for column, value in zip(out, values):
                        column.append(value)
                types = [pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64()]
                pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()), pa.array(rare_counts, pa.int64())], names=["word", "tf"])
                names = ["doc_id", "held_out", "n_words", "symbols", "shares", "inside", "known", "rare"]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)] + [pa.array(v, t) for v, t in zip(out, types)]
                                                 + [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_words long, symbols binary, shares double, inside double, "
                                "known long, rare array<struct<word: binary, tf: bigint>>")


class Model:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, np.ascontiguousarray(emit, dtype=np.float64)   # emit: state x symbol

    @classmethod
    def initial(cls, totals: np.ndarray, states: int = STATES, seed: int = SEED) -> Model:
        """Symbol totals tilted at random for each state, with states that mostly stay."""
        rng = np.random.default_rng(seed)
        emit = (totals + 0.5)[None, :] * np.exp(rng.normal(0, 0.5, (states, len(totals))))
        move = np.full((states, states), 0.1 / max(states - 1, 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def from_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, totals: np.ndarray) -> Model:
        """Expected counts smoothed by a little of the symbol totals, so no probability is zero."""
        prior = (totals + 0.5) / (totals + 0.5).sum()
        start, move, emit = start + 0.1, move + 0.1, emit + 20 * prior[None, :]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def _windows(self, parts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parts in falling length as columns of a time x part table, with their order, lengths, and the parts alive at each time.

        The last axis of every table runs over the parts, so each step is a few long vector
        operations. Places behind an end hold the extra symbol ``V``.
        """
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        lengths = lengths[order]
        table = np.full((len(parts), width), self.emit.shape[1], dtype=np.int64)
        for row, at in enumerate(order):
            table[row, :lengths[row]] = parts[at]
        alive = np.searchsorted(-lengths, -np.arange(width), side="left")        # parts longer than t
        return np.ascontiguousarray(table.T[:lengths[0]]), order, lengths, alive

    def _seen(self, table: np.ndarray) -> np.ndarray:
        """Emission probabilities, time x state x part; 1 behind an end."""
        padded = np.concatenate([self.emit, np.ones((len(self.emit), 1))], axis=1)
        return np.stack([row[table] for row in padded], axis=1)

    def counts(self, parts: list[np.ndarray], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, moves, emissions) over parts of at most ``width`` symbols."""
        table, _, lengths, alive = self._windows(parts, width)
        steps, n, k, size = len(table), len(parts), len(self.start), self.emit.shape[1]
        seen = self._seen(table)
        alpha = np.zeros((steps, k, n))
        scale = np.ones((steps, n))
        forth = np.ascontiguousarray(self.move.T)
        for t in range(steps):
            m = alive[t]
            now = (forth @ alpha[t - 1, :, :m] if t else self.start[:, None]) * seen[t, :, :m]
            total = now.sum(0)
            np.divide(now, total, out=alpha[t, :, :m])
            scale[t, :m] = total
        move, beta = np.zeros((k, k)), np.ones((k, n))
        for t in range(steps - 1, -1, -1):
            m = alive[t]
            if t + 1 < steps:
                later = alive[t + 1]
                ahead = seen[t + 1, :, :later] * beta[:, :later]
                ahead /= scale[t + 1, :later]
                move += alpha[t, :, :later] @ ahead.T
                beta[:, :later] = self.move @ ahead
            alpha[t, :, :m] *= beta[:, :m]                       # now the state probabilities
        move *= self.move
        flat = table.ravel()
        emit = np.stack([np.bincount(flat, weights=alpha[:, s].ravel(), minlength=size + 1)[:size] for s in range(k)])
        return alpha[0].sum(1), move, emit

    def log10(self, sequences: list[np.ndarray], segment: int = WINDOW) -> list[float]:
        """Exact log10 likelihoods. Segments of all sequences advance together, each from every
        state at once; then the segments of a sequence are joined in order, rescaled at each step."""
        k = len(self.start)
        parts = [s[i:i + segment] for s in sequences for i in range(0, len(s), segment)]
        out = [0.0] * len(sequences)
        if not parts:
            return out
        table, order, lengths, alive = self._windows(parts, segment)
        seen = self._seen(table)
        first = np.array([i == 0 for s in sequences for i in range(0, len(s), segment)])[order]
        through = np.repeat(np.eye(k)[:, :, None], len(parts), axis=2)          # to x from x part
        logs = np.zeros(len(parts))
        forth = np.ascontiguousarray(self.move.T)
        for t in range(len(table)):
            m = alive[t]
            step = (forth @ through[:, :, :m].reshape(k, k * m)).reshape(k, k, m)
            if t == 0:
                step[:, :, first] = self.start[:, None, None]                  # from wherever: the start
            step *= seen[t, :, None, :m]
            if t % 8 == 7 or t == len(table) - 1:
                top = step.max(axis=(0, 1))
                step /= top
                logs[:m] += np.log10(top)
            through[:, :, :m] = step
        through = np.ascontiguousarray(through.transpose(2, 0, 1))
        place = np.empty(len(parts), dtype=np.int64)
        place[order] = np.arange(len(parts))
        part = 0
        for i, s in enumerate(sequences):
            state, log = np.full(k, 1 / k), 0.0
            for _ in range(0, len(s), segment):
                row = place[part]
                state = through[row] @ state
                total = state.sum()
                state, log, part = state / total, log + np.log10(total) + logs[row], part + 1
            out[i] = float(log)
        return out


def _summed_counts(coded: DataFrame, model, width: int, symbols: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Baum-Welch pass over the training rows; cells of the count tables are summed over tasks by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = model.value
        total = np.zeros(states + states * states + states * symbols)

        def add(parts: list[np.ndarray]) -> None:
            total[:] += np.concatenate([c.ravel() for c in current.counts(parts, width)])

        held: list[np.ndarray] = []
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                s = np.frombuffer(raw, np.uint16)
                held += [s[i:i + width] for i in range(0, len(s), width)]
                while len(held) >= 512:
                    add(held[:512])
                    held = held[512:]
        if held:
            add(held)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    rows = coded.filter("NOT held_out").select("symbols").mapInArrow(run, "cell long, n double")
    summed = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(states + states * states + states * symbols)
    total[summed["cell"].to_numpy(np.int64)] = summed["n"].to_numpy(np.float64)
    a, b = states, states + states * states
    return total[:a], total[a:b].reshape(states, states), total[b:].reshape(states, symbols)


def _symbol_totals(coded: DataFrame, symbols: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(symbols, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint16), minlength=symbols)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(symbols)), pa.array(total)], names=["cell", "n"])

    rows = coded.filter("NOT held_out").select("symbols").mapInArrow(run, "cell long, n long")
    out = np.zeros(symbols)
    for r in rows.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def _likelihoods(coded: DataFrame, model) -> DataFrame:
    kind = coded.schema["doc_id"].dataType.simpleString()
    kept = ["held_out", "n_words", "shares", "inside", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 128):
                batch = whole.slice(begin, 128)
                names = batch.schema.names
                raw = batch.column(names.index("symbols")).to_pylist()
                scores = model.value.log10([np.frombuffer(r, np.uint16) for r in raw])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(names.index(n)) for n in ("doc_id", "row", *kept)] + [pa.array(scores, pa.float64())],
                    names=["doc_id", "row", *kept, "likelihood"])

    return coded.select("doc_id", "row", *kept, "symbols").mapInArrow(
        run, f"doc_id {kind}, row long, held_out boolean, n_words long, shares double, inside double, known long, likelihood double")


def train(docs: DataFrame, states: int = STATES, passes: int = PASSES):
    """The vocabulary table, the lexicon, all documents as symbols, the model, and the training totals."""
    context = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    vocabulary = stage(word_counts(texts.filter("NOT held_out").select("text")))
    documents = texts.filter("NOT held_out").count()
    row = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = row[0] + documents, row[1] + (1 if documents else 0)       # with the end token
    lexicon = _lexicon(vocabulary, documents)
    coded = stage(_encoded(texts, context.broadcast(lexicon)).withColumn("row", F.monotonically_increasing_id()))
    totals = _symbol_totals(coded, lexicon.size)
    model = Model.initial(totals, states)
    for _ in range(passes):
        model = Model.from_counts(*_summed_counts(coded, context.broadcast(model), WINDOW, lexicon.size, states), totals)
    return vocabulary, coded, model, n, v, documents


def score_documents(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """One row per document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null text counts as empty: its only token is the end. A null doc_id is not held out.
    Repeated rows are scored one by one. Without training documents every word is unseen and
    the model stays at its uniform start. Other columns are ignored; an empty table gives an
    empty result.
    """
    vocabulary, coded, model, n, v, ends = train(docs, states, passes)
    rare = coded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tf")
    found = rare.join(vocabulary, "word").groupBy("row").agg(
        F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("share"))
    rows = _likelihoods(coded, docs.sparkSession.sparkContext.broadcast(model)).join(found, "row", "left")
    share, more = F.coalesce("share", F.lit(0.0)), F.coalesce("more", F.lit(0).cast("long"))
    tokens = F.col("n_words") + 1
    base = F.col("shares") + share + float(np.log10(ends + 1)) - tokens * float(np.log10(n + v + 1))
    return rows.select(
        "doc_id", "held_out", tokens.alias("n_tokens"), (F.col("known") + more + (1 if ends else 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"),
        (F.col("likelihood") + F.col("inside") + share).alias("score"))
