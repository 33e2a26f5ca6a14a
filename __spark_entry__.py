
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from matrel import execution, oracle, storage  # noqa: E402
from matrel.functions.sketch import HLL16, HLL32  # noqa: E402
from matrel.operators import batches, coo, csr, exact, multiply as mul, placement, profile, verify, windows  # noqa: E402
from matrel.operators.joins import Limits  # noqa: E402
from matrel.plans import light  # noqa: E402
from matrel.session import new_path, stage  # noqa: E402
from matrel.sources.matrix_market import read_matrix_market, register, write_matrix_market  # noqa: E402
from matrel.sources.tables import Tables  # noqa: E402

try:
    import corpus_pipeline  # noqa: E402
    from matrel.llm import queries as corpus  # noqa: E402
except ImportError as error:
    if error.name not in ("corpus_pipeline", "matrel.llm"):
        raise
    corpus_pipeline = corpus = None

WIDTH = 256                      # column windows of the window queries
PLANNED = ["part", "supp", "cust", "label", "mix", "trade"]
SMALL_BUDGETS = {"products": 10_000, "runs": 700}
SAMPLE_ROWS = 512                # rows of the sampled verification
PARTS = 16                       # tasks of the placed product
TILE_WORK = 20_000               # products of a tile of the resumable runs
HEAVY = 4096                     # products of a heavy row (fixed value)

_open: dict[tuple[str, str], Tables] = {}


def tables(spark: SparkSession, folder: str) -> Tables:
    """The staged matrices of a folder, shared by the queries of one application."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _open:
        _open[key] = Tables(spark, folder)
    return _open[key]


def entry(spark: SparkSession, folder: str = "/root/testdata/sf0.001") -> DataFrame:
    """Flagship: the product of the order matrix with itself, form chosen by the row policy."""
    return mul.multiply(tables(spark, folder).matrix("part"))


def _on(name: str, build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: build(tables(spark, folder).matrix(name))


def _routes(matrix) -> light.LightPlan:
    return light.choose_routes(matrix)


def _over(names: list[str], build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        parts = [build(tables(spark, folder).matrix(n)).withColumn("matrix", F.lit(n)) for n in names]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    return run


def _market(name: str, symmetry: str, field: str = "real") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: read_matrix_market(spark, tables(spark, folder).market_text(name, symmetry, field)).entries


def _mtx_range(spark: SparkSession, folder: str) -> DataFrame:
    """A row range of a symmetric text through the mtx format, which takes the filter."""
    source = tables(spark, folder)
    register(spark)
    n = source.matrix("cust").n
    cells = spark.read.format("mtx").option("split_bytes", 1 << 16).load(source.market_text("cust", "symmetric"))
    return cells.filter((F.col("r") >= n // 4) & (F.col("r") < n // 2))


def _mtx_written(symmetry: str) -> Callable[[SparkSession, str], DataFrame]:
    """A matrix written as mtx parts and read back."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        m = tables(spark, folder).matrix("cust" if symmetry == "symmetric" else "part")
        if symmetry == "symmetric":
            m = coo.Matrix(coo.canonical(coo.mirrored(m.entries.filter(F.col("r") >= F.col("c")))), m.n)
        path = new_path(spark, "mtx")
        write_matrix_market(m, path, symmetry, compression="gzip" if symmetry == "symmetric" else "none")
        return read_matrix_market(spark, path).entries

    return run


def _raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    n = tables(spark, folder).matrix("sign").n
    sign = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(-1.0)
    return tables(spark, folder).table("orders").select(
        F.col("o_custkey").alias("r"), ((F.col("o_orderkey") * 5 + F.col("o_custkey")) % n).alias("c"), sign.alias("v"))


def _resumed(m) -> DataFrame:
    """A product in tiles of equal work, left after the third tile and continued by another run of the same folder."""
    path = new_path(m.entries.sparkSession, "product")
    execution.ProductRun(m, folder=path, products=TILE_WORK).run(most=3)
    again = execution.ProductRun(m, folder=path, products=TILE_WORK)
    again.run()
    return again.result()


def _manifest(m) -> DataFrame:
    """The plan of that run, with the tiles that the first call has committed."""
    work = execution.ProductRun(m, products=TILE_WORK)
    work.run(most=2)
    return work.manifest().select("begin_row", "end_row", "products", "longest", "committed")


def _audited(m) -> DataFrame:
    """Audit of a stored product after rows were lost, doubled, moved and altered."""
    work = execution.ProductRun(m, products=TILE_WORK)
    work.run()
    cells = work.stored()
    r = F.col("r")
    kind = F.when(r % 97 == 3, 0).when(r % 101 == 5, 2).otherwise(1)
    cells = cells.withColumn("times", F.explode(F.sequence(F.lit(1), kind))).filter("times > 0 AND times <= 2")
    cells = cells.filter(r % 97 != 3).withColumn("r", F.when(r % 103 == 7, r + m.n).otherwise(r))
    cells = cells.withColumn("v", F.when(F.col("r") % 107 == 11, F.col("v") + F.col("c") + 1).otherwise(F.col("v")))
    return work.audit(cells.select("tile", "r", "c", "v")).select("r", "problem")


def _clustered(m) -> coo.Matrix:
    """The matrix stored in Z-order, read back."""
    spark = m.entries.sparkSession
    path = new_path(spark, "clustered")
    storage.write_clustered(m, path)
    return storage.read_clustered(spark, path, m.n)


def _clustered_range(m) -> DataFrame:
    """A block of rows and columns of the stored matrix."""
    stored = _clustered(m)
    return stored.entries.filter(coo.between("r", m.n // 4, m.n // 2) & coo.between("c", WIDTH, 2 * WIDTH))


def _bucketed(m) -> DataFrame:
    """The product of factors stored on the contraction index."""
    return storage.co_partitioned_multiply(storage.co_partition(m), m.entries.sparkSession)


def _placed(m) -> DataFrame:
    """The merge form with rows placed by their products."""
    return placement.placed_multiply(m.entries, m.entries, stage(profile.row_features(m)), m.n, PARTS)


def _shares(m) -> DataFrame:
    """What each task of that product has to do."""
    return placement.share_summary(placement.shares(profile.row_features(m), m.n, PARTS))


def _ratios(m) -> coo.Matrix:
    """The matrix with values that no binary fraction holds."""
    return coo.Matrix(m.entries.withColumn("v", F.col("v") / 7), m.n)


def _exact(m) -> DataFrame:
    """True sums of single-precision products, in units of 2**-52."""
    sums = exact.exact_multiply(_ratios(m))
    units = F.col("numerator").cast("decimal(38,0)") * F.pow(F.lit(2.0), F.col("exponent") + 52).cast("decimal(20,0)")
    return sums.select("r", "c", units.cast("decimal(38,0)").cast("string").alias("units"))


def _verify_single(m) -> DataFrame:
    """Verification of the product in single precision, whose deviation is not zero."""
    m = _ratios(m)
    found = verify.report(verify.verify(coo.Matrix(exact.single(m.entries), m.n), exact.single_multiply(m)), m.n)
    return found.select("cells", "mismatches", "bad_rows", (F.col("max_deviation") > 0).alias("deviates"), "checked_rows", "total_rows")


def _heavy(m) -> DataFrame:
    """Products of the rows over the heavy threshold, by the two-stage sum."""
    heavy = stage(mul.keep_rows(m.entries, mul.heavy_rows(profile.row_features(m))))
    return mul.heavy_multiply(heavy, m.entries)


def _row_batches(m) -> DataFrame:
    rows = stage(profile.row_features(m).select("r", "products", "runs"))
    return batches.row_batches(rows, m.n, SMALL_BUDGETS, even=True)


def _row_ranges(m) -> DataFrame:
    rows = stage(profile.row_features(m).select("r", "products", "runs"))
    return batches.row_batches(rows, m.n, {"products": 2_000_000, "runs": 30_000})


def _cross_mode(m) -> DataFrame:
    """Row structures of the product, and whether the three forms agree on them."""
    digests = [
        csr.fingerprints(mul.multiply(m, mode=mode)).select("r", F.struct("row_nnz", "fp_xor", "fp_sum").alias("f"), F.lit(mode).alias("mode"))
        for mode in ("merge", "dense", "adaptive")]
    rows = digests[0].unionByName(digests[1]).unionByName(digests[2]).groupBy("r").agg(
        F.min("f").alias("f"), ((F.count(F.lit(1)) == 3) & (F.min("f") == F.max("f"))).alias("agree"))
    return rows.select("r", "f.*", "agree")


def _damaged(spark: SparkSession, folder: str) -> DataFrame:
    """Broken invariants of a matrix with repeated cells, shifted rows and zeros."""
    source = tables(spark, folder)
    n = source.matrix("part").n
    cells = source.table("lineitem").select(
        (F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, n).otherwise(0)).alias("r"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber") % 2) % n).alias("c"), (F.col("l_quantity") - 25).alias("v"))
    return csr.violations(cells, n)


def _descending(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, cut at every 4096 orders, whose columns do not ascend in the order of their lines."""
    source = tables(spark, folder)
    n = source.matrix("part").n
    items = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n).alias("c"))))
    packed = source.table("lineitem").groupBy(F.col("l_partkey").alias("r"), F.expr("l_orderkey div 4096").alias("w")).agg(items.alias("items"))
    return csr.descending_steps(packed.select("r", "w", F.col("items.c").alias("columns"))).select("r", "w")


def _verify_range(m) -> DataFrame:
    """Verification of one row range and column window."""
    rows, columns = (m.n // 4, m.n // 2), (WIDTH, 2 * WIDTH)
    left = coo.Matrix(m.entries.filter(coo.between("r", *rows)), m.n)
    right = coo.Matrix(m.entries.filter(coo.between("c", *columns)), m.n)
    part = mul.multiply(m, mode="dense", rows=rows, columns=columns)
    return verify.report(verify.verify(left, part, right), rows[1] - rows[0])


def _csr_rows(m) -> DataFrame:
    packed = csr.packed_rows(m.entries, WIDTH)
    return packed.select(
        "r", "w", F.size("columns").cast("long").alias("items"),
        F.element_at("columns", 1).alias("first_c"), F.element_at("columns", -1).alias("last_c"),
        F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"))


def _verify_cells(m) -> DataFrame:
    return verify.verify(m, mul.multiply(m, mode="dense", keep_structural=True))


def _verify_report(m) -> DataFrame:
    return verify.report(verify.verify(m, mul.multiply(m, mode="dense")), m.n)


def _verify_sample(m) -> DataFrame:
    checked = verify.verify(m, mul.multiply(m, mode="merge"), sample_rows=SAMPLE_ROWS)
    return verify.report(checked, m.n, SAMPLE_ROWS)


def _violations(m) -> DataFrame:
    cells = mul.multiply(m, mode="merge", keep_structural=True)
    return csr.violations(cells, m.n, -(-mul.product_count(m) // Limits().pairs_per_task))


def _island_summary(m) -> DataFrame:
    return batches.island_summary(batches.merge_islands(_routes(m).routes.withColumn("tasks", F.col("runs")), m.n))


def _sampled(m) -> DataFrame:
    plan = _routes(m)
    return plan.samples.select("r", "bin", "products", "estimate", "ratio")


def _row_range(m) -> DataFrame:
    return mul.multiply(m, mode="merge", rows=(m.n // 4, m.n // 2))


def _column_window(m) -> DataFrame:
    return mul.multiply(m, mode="merge", columns=(WIDTH, 2 * WIDTH))


def _product_check(m) -> DataFrame:
    """Products from the row features against products of the join."""
    none = F.lit(0).cast("long")
    profiled = profile.row_features(m).select(F.col("products").alias("p"), none.alias("j"))
    joined = mul.partial_products(m.entries, m.entries).select(none.alias("p"), F.lit(1).cast("long").alias("j"))
    return profiled.unionByName(joined).agg(F.sum("p").alias("profiled_products"), F.sum("j").alias("joined_products"))


def _features(m) -> DataFrame:
    return profile.row_features(m)


def _whole_row(m) -> DataFrame:
    return _routes(m).routes.select("r", "route")


def _estimates(kind) -> Callable:
    return lambda m: profile.output_estimates(m.entries, m, kind)


def _output_bound(m) -> DataFrame:
    return windows.window_work(m, width=WIDTH).groupBy("r").agg(F.sum("out_upper").alias("out_upper"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q: dict[str, Callable[[SparkSession, str], DataFrame]] = {
        # products
        "spgemm_merge": _on("part", lambda m: mul.multiply(m, mode="merge")),
        "spgemm_dense": _on("supp", lambda m: mul.multiply(m, mode="dense")),
        "spgemm_dense_sparse": _on("cust", lambda m: mul.multiply(m, mode="dense")),
        "spgemm_adaptive": _on("blend", lambda m: mul.multiply(m, mode="adaptive")),
        "spgemm_auto": _on("blend", lambda m: mul.multiply(m, calibrated=True)),
        "spgemm_auto_by_work": _on("supp", lambda m: mul.multiply(m)),
        "spgemm_trade": _on("trade", lambda m: mul.multiply(m, mode="dense")),
        "spgemm_structural": _on("sign", lambda m: mul.multiply(m, mode="merge", keep_structural=True)),
        "spgemm_structural_dense": _on("sign", lambda m: mul.multiply(m, mode="dense", keep_structural=True)),
        "spgemm_signed_cancel": _on("sign", lambda m: mul.multiply(m, mode="merge")),
        "spgemm_direct_rows": _on("label", lambda m: mul.direct_multiply(m.entries, m.entries)),
        "spgemm_heavy_rows": _on("blend", _heavy),
        "spgemm_row_range": _on("cust", _row_range),
        "spgemm_window": _on("cust", _column_window),
        "spgemm_tiled": _on("cust", lambda m: execution.tiled_multiply(m, rows=-(-m.n // 3), columns=-(-m.n // 2), mode="merge")),
        "spgemm_resumed": _on("cust", _resumed),
        "tile_manifest": _on("cust", _manifest),
        "tile_audit": _on("cust", _audited),
        "spgemm_exact": _on("cust", _exact),
        "verify_single": _on("cust", _verify_single),
        "spgemm_placed": _on("blend", _placed),
        "work_shares": _on("blend", _shares),
        "spgemm_co_partitioned": _on("cust", _bucketed),
        "spgemm_window_clustered": _on("cust", lambda m: mul.multiply(m, _clustered(m), mode="merge", columns=(WIDTH, 2 * WIDTH))),
        "clustered_range": _on("part", _clustered_range),
        "reference_product": _on("sign", mul.reference_product),
        "product_check": _on("part", _product_check),
        # sources and coordinate operators
        "duplicate_sum": lambda s, d: coo.canonical(_raw_orders(s, d)),
        "symmetric_expand": _on("cust", lambda m: coo.canonical(coo.mirrored(m.entries.filter(F.col("r") >= F.col("c"))))),
        "skew_expand": _on("cust", lambda m: coo.canonical(coo.mirrored(m.entries.filter(F.col("r") > F.col("c")), -1))),
        "matrix_market_general": _market("cust", "general"),
        "matrix_market_symmetric": _market("cust", "symmetric"),
        "matrix_market_hermitian": _market("cust", "hermitian"),
        "matrix_market_pattern": _market("cust", "general", "pattern"),
        "matrix_market_skew": _market("cust", "skew-symmetric"),
        "mtx_range": _mtx_range,
        "mtx_written": _mtx_written("general"),
        "mtx_written_symmetric": _mtx_written("symmetric"),
        # profiles and sketches
        "row_features": _on("part", _features),
        "row_features_sparse": _on("label", _features),
        "hll16_sketch": _on("part", lambda m: profile.sketch_rows(m.entries, HLL16)),
        "hll32_sketch": _on("cust", lambda m: profile.sketch_rows(m.entries, HLL32)),
        "hll16_estimate": _on("part", _estimates(HLL16)),
        "hll32_estimate": _on("cust", _estimates(HLL32)),
        # routes and plans
        "row_routes_light": _on("mix", lambda m: _routes(m).routes),
        "row_routes_whole_row": _on("mix", _whole_row),
        "sampled_rows": _on("mix", _sampled),
        "plan_summary": _on("mix", lambda m: _routes(m).summary()),
        "policy_decision": _over(PLANNED, lambda m: _routes(m).summary().select("light_mode", "policy_mode", "calibrated_mode")),
        # windows and batches
        "window_work": _on("part", lambda m: windows.window_work(m, width=WIDTH)),
        "window_summary": _on("part", lambda m: windows.window_totals(m, width=WIDTH)),
        "output_upper_bound": _on("part", _output_bound),
        "row_batches": _on("cust", _row_batches),
        "row_ranges": _on("mix", _row_ranges),
        "merge_islands": _on("label", lambda m: batches.merge_islands(
            _routes(m).routes.withColumn("tasks", F.col("runs")), m.n)),
        "merge_islands_mix": _on("mix", lambda m: batches.merge_islands(
            _routes(m).routes.withColumn("tasks", F.col("runs")), m.n)),
        "island_summary": _on("mix", _island_summary),
        # compressed rows, fingerprints and verification
        "csr_rowptr": _on("label", lambda m: csr.row_pointers(m.entries, m.n)),
        "csr_rows": _on("part", _csr_rows),
        "csr_violations_damaged": _damaged,
        "csr_descending": _descending,
        "verify_range": _on("cust", _verify_range),
        "csr_violations": _on("sign", _violations),
        "row_fingerprint": _on("part", lambda m: csr.fingerprints(m.entries)),
        "cross_mode_structure": _on("sign", _cross_mode),
        "verify_cells": _on("sign", _verify_cells),
        "verify_report": _on("sign", _verify_report),
        "verify_sample": _on("cust", _verify_sample),
    }
    if corpus is not None:
        q.update(corpus.queries())
        q["pipeline"] = corpus_pipeline.run
    return q


def oracle_sql() -> dict[str, str]:
    sql = matrix_sql()
    if corpus is not None:
        sql.update(corpus.oracle_sql())
        if corpus_pipeline.ORACLE_SQL is not None:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql


def matrix_sql() -> dict[str, str]:
    o = oracle
    with_light = lambda name: f"WITH {o.matrix(name)}, {o.light()}"
    mirror = lambda op, sign: f"""WITH {o.matrix('cust')}, t AS (SELECT * FROM a WHERE r {op} c)
        SELECT r, c, sum(v) AS v FROM (SELECT r, c, v FROM t UNION ALL SELECT c, r, {sign}v FROM t WHERE r <> c) GROUP BY r, c"""
    cells = lambda name: f"cells AS (SELECT r, c, sum(p) AS v FROM ({o.PRODUCTS}) GROUP BY r, c HAVING sum(p) <> 0)"
    window = lambda name, terms="": f"WITH {o.matrix(name)}, {o.window_terms(WIDTH)}{terms}"
    recursive = lambda name, terms, source, budgets, even: (
        f"WITH RECURSIVE {o.matrix(name)}, {terms}, {o.greedy(source, budgets, even)}")
    features = "r, runs, products, max_run, min_col, max_col, span, lower_bound, CAST(bin AS INTEGER) AS bin"
    return {
        "spgemm_merge": o.product("part"),
        "spgemm_dense": o.product("supp"),
        "spgemm_dense_sparse": o.product("cust"),
        "spgemm_adaptive": o.product("blend"),
        "spgemm_auto": o.product("blend"),
        "spgemm_auto_by_work": o.product("supp"),
        "spgemm_trade": o.product("trade"),
        "spgemm_structural": o.product("sign", ""),
        "spgemm_structural_dense": o.product("sign", ""),
        "spgemm_signed_cancel": o.product("sign"),
        "spgemm_direct_rows": o.product("label", where="WHERE a.r IN (SELECT r FROM a GROUP BY r HAVING count(*) = 1)"),
        "spgemm_heavy_rows": o.product("blend", where=f"""WHERE a.r IN (SELECT x.r FROM a x JOIN a y ON x.c = y.r
            GROUP BY x.r HAVING count(*) >= {HEAVY} AND count(DISTINCT x.c) > 1)"""),
        "spgemm_row_range": o.product("cust", where=f"WHERE a.r >= {o.N} // 4 AND a.r < {o.N} // 2"),
        "spgemm_window": o.product("cust", where=f"WHERE b.c >= {WIDTH} AND b.c < {2 * WIDTH}"),
        "reference_product": f"""WITH {o.matrix('sign')} SELECT r, c, sum(p) AS v, sum(abs(p)) AS abs_sum, count(*) AS terms
            FROM ({o.PRODUCTS}) GROUP BY r, c""",
        "product_check": f"""WITH {o.matrix('part')}, {o.FEATURES}
            SELECT (SELECT CAST(sum(products) AS BIGINT) FROM f) AS profiled_products, (SELECT count(*) FROM ({o.PRODUCTS})) AS joined_products""",
        "duplicate_sum": f"WITH {o.matrix('sign')} SELECT r, c, v FROM a",
        "symmetric_expand": mirror(">=", ""),
        "skew_expand": mirror(">", "-"),
        "matrix_market_general": f"WITH {o.matrix('cust')} SELECT r, c, v FROM a",
        "matrix_market_symmetric": mirror(">=", ""),
        "matrix_market_hermitian": mirror(">=", ""),
        "matrix_market_pattern": f"WITH {o.matrix('cust')} SELECT r, c, 1.0e0 AS v FROM a",
        "spgemm_tiled": o.product("cust"),
        "spgemm_resumed": o.product("cust"),
        "spgemm_exact": f"""WITH {o.matrix('cust')}, x AS (SELECT r, c, CAST(CAST(v / 7 AS FLOAT) AS DOUBLE) AS v FROM a)
            SELECT x.r, y.c, CAST(sum(CAST(x.v * y.v * 4503599627370496.0e0 AS HUGEINT)) AS VARCHAR) AS units FROM x JOIN x y ON x.c = y.r GROUP BY x.r, y.c""",
        "verify_single": f"""WITH {o.matrix('cust')} SELECT count(*) AS cells, CAST(0 AS BIGINT) AS mismatches, CAST(0 AS BIGINT) AS bad_rows,
            max(dev) > 0 AS deviates, (SELECT n FROM d) AS checked_rows, (SELECT n FROM d) AS total_rows
            FROM (SELECT a.r, b.c, abs(CAST(CAST(sum(CAST(CAST(a.v / 7 AS FLOAT) * CAST(b.v / 7 AS FLOAT) AS DOUBLE)) AS FLOAT) AS DOUBLE)
                  - sum(CAST(CAST(a.v / 7 AS FLOAT) AS DOUBLE) * CAST(CAST(b.v / 7 AS FLOAT) AS DOUBLE))) AS dev FROM a JOIN a b ON a.c = b.r GROUP BY a.r, b.c)""",
        "spgemm_placed": o.product("blend"),
        "work_shares": f"""WITH {o.matrix('blend')}, {o.FEATURES}, t AS (SELECT CAST(sum(products) AS BIGINT) AS total FROM f),
            s AS (SELECT r, products, CAST(sum(products) OVER (ORDER BY r) - products AS BIGINT) // ((total + {PARTS - 1}) // {PARTS}) AS part
                  FROM f, t WHERE products > 0)
            SELECT part, min(r) AS first_row, max(r) AS last_row, count(*) AS rows, CAST(sum(products) AS BIGINT) AS products FROM s GROUP BY part""",
        "spgemm_co_partitioned": o.product("cust"),
        "spgemm_window_clustered": o.product("cust", where=f"WHERE b.c >= {WIDTH} AND b.c < {2 * WIDTH}"),
        "clustered_range": f"WITH {o.matrix('part')} SELECT r, c, v FROM a WHERE r >= {o.N} // 4 AND r < {o.N} // 2 AND c >= {WIDTH} AND c < {2 * WIDTH}",
        "tile_manifest": f"""WITH {o.matrix('cust')}, {o.FEATURES},
            t AS (SELECT *, CAST(sum(products) OVER (ORDER BY r) - products AS BIGINT) // {TILE_WORK} AS tile FROM f)
            SELECT min(r) AS begin_row, max(r) + 1 AS end_row, CAST(sum(products) AS BIGINT) AS products, max(products) AS longest,
                   row_number() OVER (ORDER BY min(r)) <= 2 AS committed FROM t GROUP BY tile""",
        "tile_audit": f"""WITH x AS ({o.product('cust')}), s AS (SELECT DISTINCT r FROM x), d AS (SELECT max(c_custkey) + 1 AS n FROM customer)
            SELECT r, 'missing' AS problem FROM s WHERE r % 97 = 3 OR r % 103 = 7
            UNION ALL SELECT r + n, 'foreign' FROM s, d WHERE r % 97 <> 3 AND r % 103 = 7
            UNION ALL SELECT r, CASE WHEN r % 107 = 11 THEN 'altered' ELSE 'repeated' END FROM s
                WHERE r % 97 <> 3 AND r % 103 <> 7 AND (r % 107 = 11 OR r % 101 = 5)""",
        "matrix_market_skew": mirror(">=", "-"),
        "mtx_range": f"WITH s AS ({mirror('>=', '')}), d AS (SELECT max(c_custkey) + 1 AS n FROM customer) SELECT r, c, v FROM s, d WHERE r >= n // 4 AND r < n // 2",
        "mtx_written": f"WITH {o.matrix('part')} SELECT r, c, v FROM a",
        "mtx_written_symmetric": mirror(">=", ""),
        "row_features": f"WITH {o.matrix('part')}, {o.FEATURES} SELECT {features} FROM f",
        "row_features_sparse": f"WITH {o.matrix('label')}, {o.FEATURES} SELECT {features} FROM f",
        "hll16_sketch": f"WITH {o.matrix('part')}, {o.sketches(o.HLL16)} SELECT r, register, rank FROM sk",
        "hll32_sketch": f"WITH {o.matrix('cust')}, {o.sketches(o.HLL32)} SELECT r, register, rank FROM sk",
        "hll16_estimate": f"WITH {o.matrix('part')}, {o.row_estimates(o.HLL16)} SELECT r, products, estimate FROM est",
        "hll32_estimate": f"WITH {o.matrix('cust')}, {o.row_estimates(o.HLL32)} SELECT r, products, estimate FROM est",
        "row_routes_light": f"""{with_light('mix')} SELECT r, CAST(route AS INTEGER) AS route, runs, products, max_run, span, lower_bound,
            CAST(bin AS INTEGER) AS bin, eligible, ambiguous, CAST(first_route AS INTEGER) AS first_route FROM routes""",
        "row_routes_whole_row": f"WITH {o.matrix('mix')}, {o.light()} SELECT r, CAST(route AS INTEGER) AS route FROM routes",
        "sampled_rows": f"{with_light('mix')} SELECT r, CAST(bin AS INTEGER) AS bin, products, estimate, ratio FROM samples",
        "plan_summary": o.plan_summary("mix"),
        "policy_decision": o.over_matrices(PLANNED, o.plan_summary, "light_mode, policy_mode, calibrated_mode"),
        "window_work": f"{window('part')} SELECT r, w, runs, products, out_upper FROM ww",
        "window_summary": f"""{window('part')} SELECT w, CAST(sum(runs) AS BIGINT) AS tasks, CAST(sum(products) AS BIGINT) AS products,
            CAST(sum(out_upper) AS BIGINT) AS output_upper, max(runs) AS max_row_runs, max(products) AS max_row_products
            FROM ww GROUP BY w""",
        "output_upper_bound": f"{window('part')} SELECT r, CAST(sum(out_upper) AS BIGINT) AS out_upper FROM ww GROUP BY r",
        "row_batches": recursive("cust", o.FEATURES, "f", SMALL_BUDGETS, True),
        "row_ranges": recursive("mix", o.FEATURES, "f", {"products": 2_000_000, "runs": 30_000}, False),
        "merge_islands": o.islands("label"),
        "merge_islands_mix": o.islands("mix"),
        "island_summary": f"""WITH x AS ({o.islands('mix')}) SELECT count(CASE WHEN selected THEN 1 END) AS batches,
            CAST(coalesce(sum(CASE WHEN selected THEN n_rows END), 0) AS BIGINT) AS selected_rows,
            CAST(coalesce(sum(CASE WHEN selected THEN products END), 0) AS BIGINT) AS selected_products,
            CAST(coalesce(sum(CASE WHEN NOT selected THEN n_rows END), 0) AS BIGINT) AS fallback_rows FROM x""",
        "csr_rowptr": f"""WITH {o.matrix('label')}, rows_ AS ({o.ROWS}), l AS (SELECT r, count(*) AS n FROM a GROUP BY r),
            x AS (SELECT rows_.r, coalesce(n, 0) AS row_nnz FROM rows_ LEFT JOIN l ON rows_.r = l.r)
            SELECT r, row_nnz, CAST(sum(row_nnz) OVER (ORDER BY r) - row_nnz AS BIGINT) AS begin_at,
                   CAST(sum(row_nnz) OVER (ORDER BY r) AS BIGINT) AS end_at FROM x""",
        "csr_rows": f"""WITH {o.matrix('part')} SELECT r, c // {WIDTH} AS w, count(*) AS items, min(c) AS first_c, max(c) AS last_c,
            sum(v) AS total FROM a GROUP BY 1, 2""",
        "csr_violations": f"""WITH {o.matrix('sign')} SELECT r, c, 'stored zero' AS problem FROM ({o.PRODUCTS}) GROUP BY r, c HAVING sum(p) = 0""",
        "csr_violations_damaged": """WITH n AS (SELECT max(p_partkey) + 1 AS n FROM part),
            x AS (SELECT l_partkey + CASE WHEN l_linenumber = 7 THEN n ELSE 0 END AS r, (l_orderkey * 7 + l_linenumber % 2) % n AS c, l_quantity - 25 AS v FROM lineitem, n),
            g AS (SELECT r, c, count(*) AS copies, max(CASE WHEN v = 0 THEN 1 ELSE 0 END) AS zero FROM x GROUP BY r, c),
            p AS (SELECT r, c, CASE WHEN r < 0 OR r >= n OR c < 0 OR c >= n THEN 'out of range' WHEN copies > 1 THEN 'duplicate'
                  WHEN zero = 1 THEN 'stored zero' END AS problem FROM g, n) SELECT r, c, problem FROM p WHERE problem IS NOT NULL""",
        "csr_descending": """WITH x AS (SELECT l_partkey AS r, l_orderkey // 4096 AS w, l_orderkey, l_linenumber,
                (l_orderkey * 7 + l_linenumber) % (SELECT max(p_partkey) + 1 FROM part) AS c FROM lineitem),
            y AS (SELECT r, w, c, lag(c) OVER (PARTITION BY r, w ORDER BY l_orderkey, l_linenumber, c) AS before FROM x)
            SELECT DISTINCT r, w FROM y WHERE c <= before""",
        "verify_range": f"""WITH {o.matrix('cust')}, {o.verify(f"r >= {o.N} // 4 AND r < {o.N} // 2 AND c >= {WIDTH} AND c < {2 * WIDTH}")}
            {o.REPORT.format(checked=f'{o.N} // 2 - {o.N} // 4').replace('(SELECT n FROM d) AS total_rows', f'{o.N} // 2 - {o.N} // 4 AS total_rows')}""",
        "row_fingerprint": o.fingerprints("part"),
        "cross_mode_structure": f"""SELECT *, true AS agree FROM ({o.fingerprints("sign", "cells", cells("sign") + ", ")})""",
        "verify_cells": f"WITH {o.matrix('sign')}, {o.verify()} SELECT r, c, want, got, allowed, ok FROM cmp",
        "verify_report": f"WITH {o.matrix('sign')}, {o.verify()} {o.REPORT.format(checked='(SELECT n FROM d)')}",
        "verify_sample": f"""WITH {o.matrix('cust')}, {o.verify(
            f"r IN (SELECT range * ({o.N} - 1) // 511 FROM range(512))")} {o.REPORT.format(checked='least(512, (SELECT n FROM d))')}""",
    }
