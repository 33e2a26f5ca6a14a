"""Equivalent SQL for the registered queries, composed from shared WITH terms."""

from __future__ import annotations

from typing import NamedTuple

# Written out here, not taken from the engine, so a wrong constant shows (fixed values).
HASH_OFFSET, HASH_MULTIPLIERS = 2654435769, (2246822507, 3266489909)
EMPTY_REMAINDER_RANK = 31
RUN_ITEMS = 256
ISLAND_TASKS, ISLAND_ROWS, ISLAND_LEAST_ROWS, ISLAND_LEAST_PRODUCTS = (2, 180), 64, 4, 512


class Sketch(NamedTuple):
    registers: int
    index_bits: int
    alpha: float


HLL16, HLL32 = Sketch(16, 4, 0.673), Sketch(32, 5, 0.697)

MATRICES = {
    "part": ("(SELECT max(p_partkey) + 1 FROM part)", """
        SELECT l_partkey AS r, (l_orderkey * 7 + l_linenumber) % (SELECT max(p_partkey) + 1 FROM part) AS c,
               sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0"""),
    "supp": ("(SELECT max(s_suppkey) + 1 FROM supplier)", """
        SELECT l_suppkey AS r, l_partkey % (SELECT max(s_suppkey) + 1 FROM supplier) AS c,
               sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0"""),
    "cust": ("(SELECT max(c_custkey) + 1 FROM customer)", """
        SELECT o_custkey AS r, (o_orderkey * 5 + o_custkey) % (SELECT max(c_custkey) + 1 FROM customer) AS c,
               CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2"""),
    "sign": ("(SELECT max(c_custkey) + 1 FROM customer)", """
        SELECT o_custkey AS r, (o_orderkey * 5 + o_custkey) % (SELECT max(c_custkey) + 1 FROM customer) AS c,
               CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) AS DOUBLE) AS v
        FROM orders GROUP BY 1, 2 HAVING sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) <> 0"""),
    "label": ("(SELECT max(doc_id) + 1 FROM documents)", """
        SELECT r, c, CAST(sum(v) AS DOUBLE) AS v FROM (
            SELECT labels.doc_id AS r, n_chars % (SELECT max(doc_id) + 1 FROM documents) AS c, 1 + quality AS v
            FROM labels JOIN documents ON labels.doc_id = documents.doc_id
            UNION ALL
            SELECT labels.doc_id, (labels.doc_id * 17 + 5) % (SELECT max(doc_id) + 1 FROM documents), 2
            FROM labels JOIN documents ON labels.doc_id = documents.doc_id
            WHERE toxic = 1 OR quality = 0) GROUP BY 1, 2"""),
    "trade": ("(SELECT CAST(max(n_nationkey) AS BIGINT) + 1 FROM nation)", """
        SELECT CAST(c_nationkey AS BIGINT) AS r, CAST(s_nationkey AS BIGINT) AS c, sum(l_quantity) AS v
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""),
}
STACKS = {"mix": ("supp", "part"), "blend": ("supp", "cust")}


def matrix(name: str) -> str:
    """WITH terms ``d`` (n) and ``a`` (r, c, v), followed by a comma-free end."""
    if name in STACKS:
        one, two = (MATRICES[x] for x in STACKS[name])
        return f"""d AS (SELECT {one[0]} + {two[0]} AS n),
            a1 AS ({one[1]}), a2 AS ({two[1]}),
            a AS (SELECT r, c, v FROM a1 UNION ALL SELECT r + {one[0]}, c + {one[0]}, v FROM a2)"""
    n, body = MATRICES[name]
    return f"d AS (SELECT {n} AS n), a AS ({body})"


N = "(SELECT n FROM d)"
PRODUCTS = "SELECT a.r, b.c, a.v * b.v AS p FROM a JOIN a b ON a.c = b.r"
ROWS = "SELECT CAST(range AS BIGINT) AS r FROM range((SELECT n FROM d))"


def product(name: str, having: str = "HAVING sum(p) <> 0", where: str = "") -> str:
    return f"WITH {matrix(name)} SELECT r, c, sum(p) AS v FROM ({PRODUCTS} {where}) GROUP BY r, c {having}"


FEATURES = f"""
    bs AS (SELECT r AS k, count(*) AS run, min(c) AS lo, max(c) AS hi FROM a GROUP BY r),
    touched AS (SELECT a.r, CAST(sum(run) AS BIGINT) AS products, max(run) AS max_run, min(lo) AS min_col, max(hi) AS max_col
                FROM a JOIN bs ON a.c = bs.k GROUP BY a.r),
    rows_ AS ({ROWS}),
    lens AS (SELECT r, count(*) AS runs FROM a GROUP BY r),
    f0 AS (SELECT rows_.r, coalesce(runs, 0) AS runs, coalesce(products, 0) AS products, coalesce(max_run, 0) AS max_run,
                  coalesce(min_col, 0) AS min_col, coalesce(max_col, 0) AS max_col,
                  coalesce(max_col - min_col + 1, 0) AS span,
                  CASE WHEN products > 0 THEN CAST(products AS DOUBLE) / (max_col - min_col + 1) ELSE 0.0e0 END AS lower_bound
           FROM rows_ LEFT JOIN lens ON rows_.r = lens.r LEFT JOIN touched ON rows_.r = touched.r),
    f AS (SELECT *, CASE WHEN products = 0 THEN 0 ELSE
              least(7, (length(bin(products)) - 1) // 3) * 6
              + (CASE WHEN lower_bound >= 0.5 THEN 1 ELSE 0 END) + (CASE WHEN lower_bound >= 1 THEN 1 ELSE 0 END)
              + (CASE WHEN lower_bound >= 2 THEN 1 ELSE 0 END) + (CASE WHEN lower_bound >= 4 THEN 1 ELSE 0 END)
              + (CASE WHEN lower_bound >= 8 THEN 1 ELSE 0 END) END AS bin FROM f0)"""


def hashed(source: str, column: str, prefix: str, extra: str = "r, c") -> str:
    """WITH terms ending in ``{prefix}`` (extra columns, h): the 32-bit hash of ``column``."""
    times = lambda x, k: f"(({x} & 65535) * {k} + ((({x} >> 16) * {k}) & 65535) * 65536) & 4294967295"
    k1, k2 = HASH_MULTIPLIERS
    steps = [
        f"{prefix}0 AS (SELECT {extra}, (CAST({column} AS BIGINT) + {HASH_OFFSET}) & 4294967295 AS h FROM {source})",
        f"{prefix}1 AS (SELECT {extra}, xor(h, h >> 16) AS h FROM {prefix}0)",
        f"{prefix}2 AS (SELECT {extra}, {times('h', k1)} AS h FROM {prefix}1)",
        f"{prefix}3 AS (SELECT {extra}, xor(h, h >> 13) AS h FROM {prefix}2)",
        f"{prefix}4 AS (SELECT {extra}, {times('h', k2)} AS h FROM {prefix}3)",
        f"{prefix} AS (SELECT {extra}, xor(h, h >> 16) AS h FROM {prefix}4)",
    ]
    return ", ".join(steps)


def sketches(kind: Sketch, name: str = "sk") -> str:
    """Long sketches of the rows of ``a``: (r, register, rank)."""
    rest = f"(h >> {kind.index_bits})"
    return f"""{hashed('a', 'c', name + '_h')},
        {name} AS (SELECT r, CAST(h & {kind.registers - 1} AS INTEGER) AS register,
                   CAST(max(CASE WHEN {rest} = 0 THEN {EMPTY_REMAINDER_RANK}
                        ELSE {32 - kind.index_bits + 1} - length(bin({rest})) END) AS INTEGER) AS rank
                   FROM {name}_h GROUP BY 1, 2)"""


def estimate(kind: Sketch, upper: str, inverse: str = "inv", zeros: str = "zeros") -> str:
    m = kind.registers
    raw = f"({kind.alpha * m * m!r}e0 / {inverse})"
    value = f"(CASE WHEN {raw} <= {2.5 * m!r}e0 AND {zeros} > 0 THEN {m}.0e0 * ln({m}.0e0 / {zeros}) ELSE {raw} END)"
    return f"(CASE WHEN {upper} = 0 THEN 0 ELSE greatest(1, least({upper}, CAST(floor({value} + 0.5e0) AS BIGINT))) END)"


def union_estimates(kind: Sketch, keys: str, source: str, name: str) -> str:
    """(keys, inv, zeros) of sketches unioned over ``source`` (keys, register, rank)."""
    m = kind.registers
    return f"""{name}_reg AS (SELECT {keys}, register, max(rank) AS rank FROM {source} WHERE rank > 0 GROUP BY {keys}, register),
        {name} AS (SELECT {keys}, sum(pow(2.0e0, -rank)) + ({m} - count(*)) AS inv, {m} - count(*) AS zeros
                   FROM {name}_reg GROUP BY {keys})"""


def row_estimates(kind: Sketch, entries: str = "a") -> str:
    """``est`` (r, products, estimate) for the rows of ``entries``."""
    return f"""{sketches(kind)},
        u_src AS (SELECT e.r, sk.register, sk.rank FROM {entries} e JOIN sk ON e.c = sk.r),
        {union_estimates(kind, 'r', 'u_src', 'u')},
        blen AS (SELECT r AS k, count(*) AS run FROM a GROUP BY r),
        ep AS (SELECT e.r, CAST(sum(run) AS BIGINT) AS products FROM {entries} e JOIN blen ON e.c = blen.k GROUP BY e.r),
        est AS (SELECT ep.r, products, {estimate(kind, 'least(products, (SELECT n FROM d))')} AS estimate
                FROM ep JOIN u ON ep.r = u.r)"""


def light() -> str:
    """WITH terms through ``samples`` and ``routes``."""
    return f"""{FEATURES},
        g AS (SELECT *, (runs >= 17 AND products >= 512) AS eligible FROM f),
        m AS (SELECT *, eligible AND lower_bound < 8.0e0 AS ambiguous FROM g),
        gate AS (SELECT sum(CASE WHEN runs > 1 THEN products ELSE 0 END) / CAST(count(*) AS DOUBLE) >= 64 AS go FROM m),
        ranked AS (SELECT r, bin, row_number() OVER (PARTITION BY bin ORDER BY r) - 1 AS pos, count(*) OVER (PARTITION BY bin) AS size
                   FROM m WHERE ambiguous),
        quota AS (SELECT *, least(greatest(1, CAST(ceil(0.03e0 * size) AS BIGINT)), size) AS wanted FROM ranked),
        steps AS (SELECT *, (pos * wanted + size - 1) // size AS step FROM quota),
        chosen AS (SELECT r, bin FROM steps, gate WHERE go AND step < wanted AND step * size // wanted = pos),
        picked AS (SELECT a.* FROM a JOIN chosen ON a.r = chosen.r),
        {row_estimates(HLL16, 'picked')},
        samples AS (SELECT chosen.r, bin, products, estimate, CAST(products AS DOUBLE) / greatest(1, estimate) AS ratio
                    FROM chosen JOIN est ON chosen.r = est.r),
        score AS (SELECT bin, median(ratio) AS bin_compression FROM samples GROUP BY bin),
        r1 AS (SELECT m.*, CASE WHEN products = 0 OR runs = 0 THEN 0 WHEN runs = 1 THEN 1
                 WHEN eligible AND (lower_bound >= 8.0e0 OR
                      (coalesce(bin_compression, 0) >= {8.0 * 1.20!r}e0 AND lower_bound >= 0.5e0)) THEN 3 ELSE 2 END AS first_route
               FROM m LEFT JOIN score ON m.bin = score.bin),
        routes AS (SELECT *, CASE WHEN first_route = 3 AND products < 8192
                     AND count(CASE WHEN first_route = 3 THEN 1 END) OVER (PARTITION BY r // 2) < 2
                     THEN 2 ELSE first_route END AS route FROM r1)"""


SUMMARY = """
    tot AS (SELECT count(CASE WHEN route = 0 THEN 1 END) AS empty_rows, count(CASE WHEN route = 1 THEN 1 END) AS direct_rows,
        count(CASE WHEN route = 2 THEN 1 END) AS merge_rows, count(CASE WHEN route = 3 THEN 1 END) AS dense_rows,
        CAST(coalesce(sum(CASE WHEN route = 2 THEN products END), 0) AS BIGINT) AS merge_products,
        CAST(coalesce(sum(CASE WHEN route = 3 THEN products END), 0) AS BIGINT) AS dense_products,
        count(CASE WHEN first_route = 3 THEN 1 END) AS dense_before_pairing,
        count(CASE WHEN eligible THEN 1 END) AS eligible_rows, count(CASE WHEN ambiguous THEN 1 END) AS ambiguous_rows,
        (SELECT count(*) FROM samples) AS sampled_rows FROM routes),
    frac AS (SELECT *, CASE WHEN merge_products + dense_products = 0 THEN 0.0e0
        ELSE CAST(dense_products AS DOUBLE) / (merge_products + dense_products) END AS dense_work_fraction FROM tot),
    summary AS (SELECT *, CASE WHEN dense_rows = 0 THEN 'MERGE_ONLY' WHEN merge_rows = 0 OR dense_work_fraction >= 0.9e0 THEN 'DENSE_ONLY'
        WHEN dense_work_fraction >= 0.1e0 THEN 'ADAPTIVE' ELSE 'MERGE_ONLY' END AS light_mode,
        CASE WHEN dense_rows >= 8 AND dense_work_fraction BETWEEN 0.1e0 AND 0.6e0 AND merge_rows >= 16 * dense_rows
             THEN 'ADAPTIVE' ELSE 'MERGE_ONLY' END AS policy_mode FROM frac)"""
GATED = """SELECT *, CASE WHEN light_mode = 'ADAPTIVE' AND (
        (dense_work_fraction BETWEEN 0.1e0 AND 0.2e0 AND dense_rows >= 128 AND merge_rows >= 4 * dense_rows)
        OR (ambiguous_rows = 0 AND sampled_rows = 0 AND dense_work_fraction BETWEEN 0.75e0 AND 0.9e0
            AND dense_rows >= 1024 AND merge_rows >= 2 * dense_rows)) THEN 'ADAPTIVE' ELSE 'MERGE_ONLY' END AS calibrated_mode FROM summary"""


def plan_summary(name: str) -> str:
    return f"WITH {matrix(name)}, {light()}, {SUMMARY} {GATED}"


def over_matrices(names: list[str], build, columns: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS matrix, {columns} FROM ({build(n)})" for n in names)


def window_terms(width: int) -> str:
    """WITH terms ``seg`` (entries and runs of a row and window) and ``ww`` (row work per window)."""
    return f"""
        seg AS (SELECT r AS k, c // {width} AS w, count(*) AS length, (count(*) + {RUN_ITEMS - 1}) // {RUN_ITEMS} AS parts FROM a GROUP BY 1, 2),
        ww AS (SELECT a.r, w, CAST(sum(parts) AS BIGINT) AS runs, CAST(sum(length) AS BIGINT) AS products,
               least(CAST(sum(length) AS BIGINT), least({width}, {N} - w * {width})) AS out_upper
               FROM a JOIN seg ON a.c = seg.k GROUP BY a.r, w)"""


def greedy(source: str, budgets: dict[str, int], even: bool, prefix: str = "WITH RECURSIVE") -> str:
    """Greedy batches over ``source`` (r, weights) by a recursive chain of starts."""
    run = ", ".join(f"sum({w}) OVER (ORDER BY r) - {w} AS p_{w}, sum({w}) OVER (ORDER BY r) AS q_{w}" for w in budgets)
    over = " OR ".join(f"e.q_{w} - s.p_{w} > {b}" for w, b in budgets.items())
    cut = "min(e.r) + min(e.r) % 2" if even else "min(e.r)"
    sums = ", ".join(f"CAST(sum({w}) AS BIGINT) AS {w}" for w in budgets)
    return f"""pre AS (SELECT *, {run} FROM {source}),
        nxt AS (SELECT s.r, {cut} AS t FROM pre s JOIN pre e ON e.r > s.r AND ({over}) GROUP BY s.r),
        chain(begin_row) AS (SELECT CAST(0 AS BIGINT) UNION ALL SELECT nxt.t FROM chain JOIN nxt ON nxt.r = chain.begin_row WHERE nxt.t < {N}),
        spans AS (SELECT begin_row, coalesce(lead(begin_row) OVER (ORDER BY begin_row), {N}) AS end_row,
                  row_number() OVER (ORDER BY begin_row) - 1 AS batch FROM chain)
        SELECT batch, begin_row, end_row, {sums} FROM spans JOIN pre ON pre.r >= begin_row AND pre.r < end_row GROUP BY batch, begin_row, end_row"""


def islands(name: str) -> str:
    return f"""WITH {matrix(name)}, {light()},
        i0 AS (SELECT r, products, route = 2 AND runs BETWEEN {ISLAND_TASKS[0]} AND {ISLAND_TASKS[1]} AND products > 0 AS ok FROM routes),
        i1 AS (SELECT *, coalesce(max(CASE WHEN NOT ok THEN r END) OVER (ORDER BY r), -1) + 1 AS island FROM i0),
        i2 AS (SELECT r, products, island + (r - island) // {ISLAND_ROWS} * {ISLAND_ROWS} AS first_row FROM i1 WHERE ok)
        SELECT first_row, count(*) AS n_rows, CAST(sum(products) AS BIGINT) AS products,
               count(*) >= {ISLAND_LEAST_ROWS} AND sum(products) >= {ISLAND_LEAST_PRODUCTS} AS selected FROM i2 GROUP BY first_row"""


def fingerprints(name: str, source: str = "a", terms: str = "") -> str:
    return f"""WITH {matrix(name)}, {terms}
        x AS (SELECT r, CAST('0x' || substr(md5(CAST(c AS VARCHAR)), 1, 15) AS BIGINT) AS h1,
                     CAST('0x' || substr(md5(CAST(c AS VARCHAR)), 17, 10) AS BIGINT) AS h2 FROM {source})
        SELECT r, count(*) AS row_nnz, bit_xor(h1) AS fp_xor, CAST(sum(h2) AS BIGINT) AS fp_sum FROM x GROUP BY r"""


def verify(where: str = "true") -> str:
    """``cmp`` (r, c, want, got, allowed, ok): structural reference against the zero-free product."""
    return f"""ref AS (SELECT r, c, sum(p) AS v, sum(abs(p)) AS abs_sum, count(*) AS terms FROM ({PRODUCTS}) GROUP BY r, c),
        got AS (SELECT r, c, sum(p) AS v FROM ({PRODUCTS}) GROUP BY r, c HAVING sum(p) <> 0),
        tol AS (SELECT ref.r, ref.c, ref.v AS want, coalesce(got.v, 0) AS got, abs_sum, (2.0e0 * terms + 8.0e0) * {2.0**-24!r} AS u
                FROM ref LEFT JOIN got ON ref.r = got.r AND ref.c = got.c),
        lim AS (SELECT r, c, want, got, greatest(1.0e-4 + 2.0e-4 * abs(want), u / (1.0e0 - u) * abs_sum) AS allowed FROM tol WHERE {where}),
        cmp AS (SELECT *, isfinite(got) AND abs(got - want) <= allowed AS ok FROM lim)"""


REPORT = """SELECT count(*) AS cells, count(CASE WHEN NOT ok THEN 1 END) AS mismatches,
    count(DISTINCT CASE WHEN NOT ok THEN r END) AS bad_rows, coalesce(max(abs(got - want)), 0.0e0) AS max_deviation,
    {checked} AS checked_rows, (SELECT n FROM d) AS total_rows FROM cmp"""
