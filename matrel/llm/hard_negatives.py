"""Hard-negative mining by a threshold join over pruned inverted lists.

Rows and anchors are dealt to blocks of bounded size, and one task joins one block of anchors with
one block of rows. Inside, dimensions are ordered by falling energy and every row indexes only its
leading ones: the rest is left out where the norm of that suffix, times the longest anchor, stays
below the lowest threshold. Rows are sorted by the number of dimensions they index, so the list of a
dimension is a leading stretch of the rows. Partial scores grow list by list, and a pair is dropped
as soon as its partial score plus the product of the remaining norms is below the threshold of
its anchor; what is left is finished on the whole vectors.

A search asks, for every anchor, for the best ``k`` rows of some score windows. Each anchor first
meets its home block alone, with thresholds that sink from the highest possible score until the
windows are full; the best scores there are the thresholds of the first join with all
blocks, the k-th best those of the second, and the lower ends of the windows those of the third.
Only anchors with a window that is not yet full go on to the next, so no threshold is a guess: a
window is done when it holds ``k`` rows at or above its threshold, or the threshold has reached
its lower end. Within a pair of blocks only the best ``k`` of a window are returned, as no other
row can be among the best ``k`` of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.session import stage

ANCHORS_EVERY = 50
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95              # percent of the positive's score
SCALE = 256
BLOCK_VALUES = 1 << 20          # components of a block of rows; anchors take twice as many
CELLS = 1 << 22                 # partial scores held at a time
LIST_STEP = 8                   # inverted lists added between two prunings
LOWERING = (0.8, 0.6, 0.4, 0.2)  # thresholds in a home block, as shares of the highest possible score
EXACT = float(1 << 53)
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
_STORED = {"smallint": 1 << 15, "int": 1 << 31, "bigint": 1 << 63}


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, vector, norm`` of the rows that take part, each different row once.

    A row takes part if vec_id, label and vector are not null, all components are finite, and the
    squared norm of ``floor(scale * x)`` is below 2 ** 62, so that every score fits a long.
    """
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.cast("array<double>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False)))
    scaled = F.transform("embedding", lambda x: F.floor(x * float(scale)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", "label", scaled.alias("vector")).withColumn("norm", norm).filter(F.col("norm") < 2.0 ** 31).distinct()


# --- one pair of blocks ------------------------------------------------------------------------

def _suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of each row from dimension i on, for i in 0..d."""
    out = np.zeros((len(m), m.shape[1] + 1))
    squares = m.astype(np.float64) ** 2
    np.cumsum(squares[:, ::-1], axis=1, out=out[:, -2::-1])
    return np.sqrt(out)


def threshold_pairs(anchors: np.ndarray, thresholds: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (anchor, row, score) with a score of at least the anchor's threshold, in pieces of whole anchors.

    ``anchors`` and ``rows`` are integer matrices of one width.
    """
    if not len(anchors) or not len(rows):
        return
    order = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    longest = math.sqrt(max((m.astype(np.float64) ** 2).sum(axis=1).max() for m in (anchors, rows)))
    kind = np.float64 if longest * longest < EXACT else np.int64
    anchors, rows = anchors[:, order].astype(kind), rows[:, order].astype(kind)
    rest_a, rest_r = _suffix_norms(anchors), _suffix_norms(rows)
    margin = 1 + 1e-9
    by_threshold = np.argsort(-thresholds, kind="stable")
    step = max(1, CELLS // len(rows))
    width = rows.shape[1]
    list_step = max(LIST_STEP, width // 4)
    for at in range(0, len(anchors), step):
        own = by_threshold[at:at + step]
        a, ra, t = anchors[own], rest_a[own], thresholds[own].astype(np.float64)
        # leading dimensions that a row indexes: its suffix alone cannot reach the lowest threshold
        covered = rest_r * (ra[:, 0].max() * margin) < t.min()
        indexed = np.where(covered.any(axis=1), covered.argmax(axis=1), width)
        by_length = np.argsort(-indexed, kind="stable")
        listed = int((indexed > 0).sum())               # rows that index nothing are no candidates
        by_length, lengths = by_length[:listed], indexed[by_length[:listed]]
        partial = np.zeros((len(own), listed), kind)
        left = []                                       # pairs out of the lists: anchor, row, score, dimensions added
        for dim in range(0, width, list_step):
            end = min(dim + list_step, width)
            lists = rows[by_length[:listed], dim:end]
            if listed and lengths[listed - 1] < end:
                lists = np.where(np.arange(dim, end)[None, :] < lengths[:listed, None], lists, 0)
            partial = partial[:, :listed] + a[:, dim:end] @ lists.T
            more = int(np.searchsorted(-lengths, -end, side="left")) if end < width else 0     # rows with longer lists
            for size in np.unique(lengths[more:listed]):      # lists that end here
                at_end = np.flatnonzero(lengths[more:listed] == size) + more
                bound = partial[:, at_end] + np.multiply.outer(ra[:, size], rest_r[by_length[at_end], size] * margin)
                i, k = np.nonzero(bound >= t[:, None])
                left.append((i, by_length[at_end[k]], partial[i, at_end[k]], np.full(len(i), size)))
            listed = more
            if not listed:
                break
            alive = partial[:, :listed] + np.multiply.outer(ra[:, end], rest_r[by_length[:listed], end] * margin) >= t[:, None]
            if np.count_nonzero(alive) * 8 < alive.size:
                i, j = np.nonzero(alive)
                left.append((i, by_length[j], partial[i, j], np.full(len(i), end)))
                break
        if not left:
            continue
        i, row, score, at_dim = map(np.concatenate, zip(*left))
        # the surviving pairs are finished on the whole vectors, pruned again on the way
        while len(i) and (begin := int(at_dim.min())) < width:
            end = min(begin + LIST_STEP, width)
            for lo in range(0, len(i), CELLS // LIST_STEP):
                part = slice(lo, lo + CELLS // LIST_STEP)
                terms = a[i[part], begin:end] * rows[row[part], begin:end]
                terms[np.arange(begin, end)[None, :] < at_dim[part, None]] = 0
                score[part] += terms.sum(axis=1)
            at_dim = np.maximum(at_dim, end)
            keep = ra[i, at_dim] * rest_r[row, at_dim] * margin + score >= t[i]
            i, row, at_dim, score = i[keep], row[keep], at_dim[keep], score[keep]
        score = score.astype(np.int64)
        keep = score >= thresholds[own][i]
        yield own[i[keep]], row[keep], score[keep]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Integer vectors, filled up with zeros to one width."""
    column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), flat.dtype)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _best(order: list[np.ndarray], group: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each group in the given order (most important key first)."""
    at = np.lexsort((*order[::-1], group))
    g = group[at]
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    rank = np.arange(len(g)) - np.repeat(begins, np.diff(np.r_[begins, len(g)]))
    return at[rank < k]


_HIT = "anchor long, window int, score long, vec_id long, row long"


class _Pair:
    """One block of anchors, with their windows, and one block of rows."""

    def __init__(self, table: pa.Table, width: int, k: int, same: bool):
        side = table.column("side").to_numpy()
        left, right = table.filter(pa.array(side == 0)), table.filter(pa.array(side == 1))
        self.k, self.same = k, same
        self.a, self.r = _matrix(left.column("vector"), width), _matrix(right.column("vector"), width)
        self.a_row, self.a_label = left.column("row").to_numpy(), left.column("label").to_numpy()
        self.r_row, self.r_label, self.r_id = (right.column(c).to_numpy() for c in ("row", "label", "vec_id"))
        windows = left.column("windows").combine_chunks()
        self.owner = np.repeat(np.arange(len(self.a)), np.diff(windows.offsets.to_numpy()))
        flat = windows.flatten()
        self.number, self.at, self.lo, self.hi = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("window", "at", "lo", "hi"))

    def hits(self, chosen: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The best k rows of the chosen windows at or above ``at``: window place, row place, score."""
        owner = self.owner[chosen]                          # ascending
        begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        anchors = owner[begins]
        lowest = np.minimum.reduceat(at, begins)
        ends = np.r_[begins[1:], len(owner)]
        labels = self.a_label[anchors]
        parts = [np.flatnonzero(labels == x) for x in np.unique(labels)] if self.same else [np.arange(len(anchors))]
        out = [(np.empty(0, np.int64),) * 3]
        for part in parts:
            rows = np.flatnonzero(self.r_label == labels[part[0]]) if self.same else np.arange(len(self.r))
            for i, j, score in threshold_pairs(self.a[anchors[part]], lowest[part], self.r[rows]):
                i, j = part[i], rows[j]
                keep = self.a_row[anchors[i]] != self.r_row[j]
                if not self.same:
                    keep &= labels[i] != self.r_label[j]
                i, j, score = i[keep], j[keep], score[keep]
                counts = ends[i] - begins[i]                # every pair meets the windows of its anchor
                again = np.repeat(np.arange(len(i)), counts)
                w = np.arange(len(again)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[i][again]
                fits = (score[again] >= at[w]) & (score[again] <= self.hi[chosen[w]])
                again, w = again[fits], w[fits]
                j, score = j[again], score[again]
                best = _best([~score, self.r_id[j], self.r_row[j]], w, self.k)
                out.append((chosen[w[best]], j[best], score[best]))
        return tuple(map(np.concatenate, zip(*out)))

    def lowered(self) -> tuple[np.ndarray, ...]:
        """The best k rows of every window, with thresholds that sink until it is full."""
        squares = [(m.astype(np.float64) ** 2).sum(axis=1) for m in (self.a, self.r)]
        most = np.sqrt(squares[0] * squares[1].max(initial=0))[self.owner]
        top = np.minimum(most, self.hi.astype(np.float64))
        open_, out = np.arange(len(self.owner)), [(np.empty(0, np.int64),) * 3]
        for share in (*LOWERING, None):
            if not len(open_):
                break
            at = self.lo if share is None else np.maximum(np.floor(np.minimum(top * share, 2.0 ** 62)).astype(np.int64), self.lo)
            at = at[open_]
            w, j, score = self.hits(open_, at)
            full = (np.bincount(w, minlength=len(self.owner))[open_] >= self.k) | (at <= self.lo[open_])
            done = np.isin(w, open_[full])
            out.append((w[done], j[done], score[done]))
            open_ = open_[~full]
        return tuple(map(np.concatenate, zip(*out)))

    def table(self, w: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.Table:
        columns = [self.a_row[self.owner[w]], self.number[w], score, self.r_id[j], self.r_row[j]]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "window", "score", "vec_id", "row"])


_HIT = "anchor long, window int, score long, vec_id long, row long"


def _join_blocks(width: int, k: int, same: bool, home: bool):
    def run(table: pa.Table) -> pa.Table:
        pair = _Pair(table, width, k, same)
        if not len(pair.owner):
            return pair.table(*(np.empty(0, np.int64),) * 3)
        return pair.table(*(pair.lowered() if home else pair.hits(np.arange(len(pair.owner)), pair.at)))

    return run


# --- searches over all blocks ------------------------------------------------------------------

class Blocks:
    """Staged rows with their numbers and blocks.

    ``rows``: ``row, vec_id, label, vector, block``. The vectors are stored in the narrowest
    integer type that holds all components. Blocks are dealt by the hash of the row.
    """

    def __init__(self, rows: DataFrame, values: int = BLOCK_VALUES):
        rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
        seen = rows.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max("norm")).first()
        self.count, self.width = seen[0], max(seen[1] or 0, 1)
        self.block_rows = max(1, values // self.width)
        self.number = max(1, -(-self.count // self.block_rows))
        kind = next(name for name, limit in _STORED.items() if (seen[2] or 0) < limit)
        self.rows = rows.select("row", "vec_id", "label", F.col("vector").cast(f"array<{kind}>").alias("vector"),
                                F.pmod(F.xxhash64("row"), F.lit(self.number)).alias("block"))


def _windows(*fields: Column) -> Column:
    return F.struct(*[c.cast(t).alias(n) for c, t, n in zip(fields, ("int", "long", "long", "long"), ("window", "at", "lo", "hi"))])


def _joined(blocks: Blocks, requests: DataFrame, pending: int, k: int, same: bool, home: bool) -> DataFrame:
    """Hits of the requests in their home block, or in all other blocks; ``pending`` bounds their number."""
    per_block = max(1, 2 * blocks.block_rows)
    groups = 1 if home else max(1, -(-pending // per_block))
    own = requests.join(blocks.rows, "row")
    own = own.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)))
    if home:
        own = own.withColumn("met", F.col("block"))
    else:
        every = F.sequence(F.lit(0).cast("long"), F.lit(blocks.number - 1).cast("long"))
        own = own.withColumn("met", F.explode(F.array_remove(every, F.col("block"))))
    names = ["row", "vec_id", "label", "vector"]
    left = own.select((F.col("met") * groups + F.col("part")).alias("pair"), F.lit(0).alias("side"), *names, "windows")
    none = F.lit(None).cast(left.schema["windows"].dataType)
    right = blocks.rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    right = right.select((F.col("block") * groups + F.col("part")).alias("pair"), F.lit(1).alias("side"), *names, none.alias("windows"))
    dealt = left.unionAll(right).repartition(max(1, blocks.number * groups), "pair")
    return dealt.groupBy("pair").applyInArrow(_join_blocks(blocks.width, k, same, home), _HIT)


def search(blocks: Blocks, requests: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor, window, score, vec_id, row``: the best ``k`` rows of every window of every request.

    ``requests`` holds ``row`` (an anchor) and ``windows``, structs of (window, at, lo, hi). Rows of
    the anchor's own label are searched with ``same``, else those of all others.
    """
    home = stage(_joined(blocks, requests, 0, k, same, home=True))
    flat = requests.select(F.col("row").alias("anchor"), F.inline("windows")).drop("at")
    if blocks.number == 1:
        return home
    scores = home.groupBy("anchor", "window").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
    state = flat.join(scores, ["anchor", "window"], "left").select(
        "anchor", "window", "lo", "hi", F.coalesce(F.element_at("scores", 1), "lo").alias("first"),
        F.when(F.size("scores") >= k, F.element_at("scores", k)).otherwise(F.col("lo")).alias("second"))
    state = stage(state)
    full, found = [], home
    for threshold in ("first", "second", "lo"):
        asked = state.groupBy(F.col("anchor").alias("row")).agg(
            F.collect_list(_windows(F.col("window"), F.col(threshold), F.col("lo"), F.col("hi"))).alias("windows"))
        asked = stage(asked)
        pending = asked.count()
        if not pending:
            break
        hits = _joined(blocks, asked, pending, k, same, home=False)
        known = found.join(state.select("anchor", "window", F.col(threshold).alias("at")), ["anchor", "window"]).filter("score >= at").drop("at")
        hits = stage(_ranked(hits.unionByName(known), k).drop("rank"))
        counts = hits.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n"))
        state = state.join(counts, ["anchor", "window"], "left").withColumn("full", (F.coalesce("n", F.lit(0)) >= k) | (F.col(threshold) <= F.col("lo")))
        state = stage(state.drop("n"))
        full.append(hits.join(state.filter("full").select("anchor", "window"), ["anchor", "window"], "left_semi"))
        state = state.filter("NOT full").drop("full")
    out = full[0] if full else home
    for part in full[1:]:
        out = out.unionByName(part)
    return out


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The best ``k`` hits of each window, with their rank; at most k a pair of blocks come in."""
    taken = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "vec_id", "row")))
    best = hits.groupBy("anchor", "window").agg(F.slice(taken, 1, k).alias("best"))
    return best.select("anchor", "window", F.posexplode("best").alias("place", "hit")).select(
        "anchor", "window", (-F.col("hit.order")).alias("score"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.row").alias("row"),
        (F.col("place") + 1).cast("int").alias("rank"))


def hard_negatives(embeddings: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of all anchors.

    ``is_anchor`` and ``label`` (the label to use) are expressions over vec_id and label. Scores
    are inner products of the vectors as ``quantised`` makes them; higher ones come first, ties by
    smaller vec_id. Of an anchor the first ``positives`` other rows of its label are positives; for each, the
    first ``negatives`` rows of other labels with a score of ``low`` to ``high`` percent of the positive's are returned.

    Rows with a null vec_id, label or vector, or a null or non-finite component, take no part.
    Repeated equal rows count once; different rows of one vec_id are rows of their own. Shorter
    vectors are filled up with zeros, empty ones score 0. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = quantised(embeddings)
    if label is not None:
        rows = rows.withColumn("label", label)
    blocks = Blocks(rows, block_values)
    anchors = blocks.rows.filter(is_anchor).select("row", F.col("vec_id").alias("anchor_id"))
    wide = F.lit(LOWEST), F.lit(LOWEST), F.lit(HIGHEST)
    asked = anchors.select("row", F.array(_windows(F.lit(0), *wide)).alias("windows"))
    found = stage(_ranked(search(blocks, asked, positives, same=True), positives))
    # per anchor one window for each positive; those of a negative positive score are empty
    whole = "score div 100 * {0} + (score % 100 * {0} + {1}) div 100"          # does not overflow
    lo, hi = F.expr(whole.format(low, 99)), F.expr(whole.format(high, 0))
    windows = found.filter("score >= 0").select("anchor", F.col("rank").alias("window"), lo.alias("lo"), hi.alias("hi")).filter("lo <= hi")
    asked = windows.groupBy(F.col("anchor").alias("row")).agg(F.collect_list(_windows(F.col("window"), F.col("lo"), F.col("lo"), F.col("hi"))).alias("windows"))
    mined = _ranked(search(blocks, stage(asked), negatives, same=False), negatives)
    mined = mined.select("anchor", "window", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = found.select("anchor", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = mined.join(pairs, ["anchor", "window"]).join(anchors.withColumnRenamed("row", "anchor"), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every 50th vector; the label of every seventh one is shifted by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(embeddings, F.col("vec_id") % ANCHORS_EVERY == 0, moved)


SQL = f"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
           [CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM e a JOIN e b ON a.vec_id % {ANCHORS_EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
