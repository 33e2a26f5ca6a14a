"""Sparse matrix product: contraction join, product, two-key sum.

One logical operator with three physical forms that return the same rows:

* ``merge``    - join the entries and let Spark aggregate by (row, column);
* ``dense``    - join tiles of entries and add into direct-address workspaces;
* ``adaptive`` - each output row takes the form its route names.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions.bits import lng
from matrel.operators.coo import Matrix, between
from matrel.operators.grid import grid_sums, repays
from matrel.operators.joins import JoinShape, Limits, balanced, join_shape, lookup, spread_join
from matrel.operators.profile import row_features
from matrel.operators.tiles import tile_products, tiled
from matrel.session import stage

DIRECT_ROUTE, DENSE_ROUTE = 1, 3
_FAR = 1 << 62
HEAVY_PRODUCTS = 4096      # fixed value: default threshold of heavy rows
MODES = ("merge", "dense", "adaptive", "auto")
MODE_ALIASES = {
    "merge_only": "merge", "dense_only": "dense", "row_adaptive": "adaptive",
    "merge_preferred_capacity_safe": "merge",
}


def resolve_mode(mode: str) -> str:
    mode = MODE_ALIASES.get(mode.lower(), mode.lower())
    if mode not in MODES:
        raise ValueError(f"unknown execution mode: {mode}")
    return mode


def joined_entries(a: DataFrame, b: DataFrame, limits: Limits = Limits(),
                   shape: JoinShape | None = None) -> DataFrame:
    """(r, k, c, p): one row per pair of A(i,k) and B(k,j).

    For a broadcast join A is spread by whole rows, so that the sum needs no
    second shuffle, unless one row holds a large share of a task's entries;
    then it is spread by single entries.
    """
    left = a.select("r", F.col("c").alias("k"), F.col("v").alias("va"))
    right = b.select(F.col("r").alias("kb"), "c", F.col("v").alias("vb"))
    shape = shape or join_shape(left, "k", right, "kb", limits)
    by = None
    if limits.broadcasts(shape.right_rows, right):
        by = ["r"] if balanced(left, "r", "k", shape, limits) else ["r", "k"]
    joined = spread_join(left, "k", ["r", "k"], right, "kb", ["c"], shape, limits, spread_by=by)
    return joined.select("r", "k", "c", (F.col("va") * F.col("vb")).alias("p"))


def partial_products(a: DataFrame, b: DataFrame, limits: Limits = Limits(),
                     shape: JoinShape | None = None) -> DataFrame:
    """One row (r, c, p) per pair of A(i,k) and B(k,j)."""
    return joined_entries(a, b, limits, shape).select("r", "c", "p")


def _dealt(products: DataFrame, parts: int, *keys: str) -> DataFrame:
    """``products`` over ``parts`` tasks by the keys of a sum, if that is more than its exchange would have."""
    if parts > int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        products = products.repartition(parts, *keys)
    return products


def summed(products: DataFrame, keep_structural: bool, value: str = "p", parts: int = 0) -> DataFrame:
    """Two-key sum; exact zeros are dropped unless the structure is kept.

    The exchange of an aggregate has the session's number of partitions, which
    adaptive execution can lower but not raise. Where the products call for more
    ``parts``, they are dealt by cell first.
    """
    cells = _dealt(products, parts, "r", "c").groupBy("r", "c").agg(F.sum(value).alias("v"))
    return cells if keep_structural else cells.filter(F.col("v") != 0)


def merge_multiply(a: DataFrame, b: DataFrame, keep_structural: bool = False,
                   limits: Limits = Limits(), shape: JoinShape | None = None) -> DataFrame:
    shape = shape or join_shape(a, "c", b, "r", limits)
    right = b.select("r", "c", "v")
    if not limits.broadcasts(shape.right_rows, right) and repays(shape, limits):
        return gridded(a, b, keep_structural, limits, shape, direct=True)
    whole_rows = limits.broadcasts(shape.right_rows, right) and balanced(a, "r", "c", shape, limits)
    parts = 0 if whole_rows else shape.partitions(limits)
    shape = replace(shape, longest=0 if whole_rows else _FAR)       # decided above, not counted again
    return summed(partial_products(a, b, limits, shape), keep_structural, parts=parts)


def gridded(a: DataFrame, b: DataFrame, keep_structural: bool, limits: Limits, shape: JoinShape, direct: bool = False) -> DataFrame:
    """The product without an exchange of products; see ``grid``."""
    left = a.select("r", F.col("c").alias("k"), F.col("v").alias("va"))
    right = b.select(F.col("r").alias("kb"), "c", F.col("v").alias("vb"))
    return grid_sums(left, right, ["vb"], shape, limits, keep_structural, direct).withColumnRenamed("v0", "v")


def dense_multiply(a: DataFrame, b: DataFrame, keep_structural: bool = False,
                   limits: Limits = Limits()) -> DataFrame:
    """Tiles where B is small and its tiles are filled, else cells of a grid, which an empty neighbourhood does not enlarge."""
    shape = join_shape(a, "c", b, "r", limits)
    if tiled(a, b, shape, limits):
        return summed(tile_products(a, b, limits, keep_structural), keep_structural, "v")
    return gridded(a, b, keep_structural, limits, shape, direct=True)


def heavy_multiply(a: DataFrame, b: DataFrame, keep_structural: bool = False,
                   limits: Limits = Limits(), ways: int = 8, shape: JoinShape | None = None) -> DataFrame:
    """Two-stage sum: cells are first summed per contraction residue, then joined up.

    The residue splits the sum of a single very hot cell over ``ways`` groups.
    """
    shape = shape or join_shape(a, "c", b, "r", limits)
    if not limits.broadcasts(shape.right_rows, b.select("r", "c", "v")) and repays(shape, limits):
        return gridded(a, b, keep_structural, limits, shape, direct=True)      # a task sums a row piece by piece
    joined = joined_entries(a, b, limits, shape).select("r", "c", F.pmod("k", lng(ways)).alias("way"), "p")
    parts = _dealt(joined, shape.partitions(limits), "r", "c", "way").groupBy("r", "c", "way").agg(F.sum("p").alias("p"))
    return summed(parts, keep_structural)


def direct_multiply(a: DataFrame, b: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Output rows of A rows with a single entry: a scaled row of B, nothing to sum."""
    single = a.groupBy("r").agg(F.count(F.lit(1)).alias("runs"), F.max("c").alias("c"), F.max("v").alias("v"))
    entries = single.filter(F.col("runs") == 1).drop("runs")
    return partial_products(entries, b, limits).withColumnRenamed("p", "v").filter(F.col("v") != 0)


def heavy_rows(features: DataFrame, products: int = HEAVY_PRODUCTS) -> DataFrame:
    """Rows whose products reach the heavy threshold; 0 turns the class off."""
    return features.filter(F.lit(products > 0) & (F.col("runs") > 1) & (F.col("products") >= products))


def keep_rows(a: DataFrame, rows: DataFrame, limits: Limits = Limits(), how: str = "left_semi") -> DataFrame:
    """Entries of A whose row is (or, with ``left_anti``, is not) among the unique rows of ``rows``."""
    keys = rows.select(F.col("r").alias("kept_r"))
    return lookup(a, "r", ["c"], keys, "kept_r", limits, how=how)


def _classes(routes: DataFrame, limits: Limits) -> DataFrame:
    """Routes with the ``form`` of each row: dense, direct, heavy or merge.

    A row is heavy when it makes more than a quarter of one task's share of products: dealing
    whole rows to tasks would leave one task behind.
    """
    threshold = max(HEAVY_PRODUCTS, limits.pairs_per_task // 4)
    form = (
        F.when(F.col("route") == DENSE_ROUTE, "dense").when(F.col("route") == DIRECT_ROUTE, "direct")
        .when(F.col("products") >= threshold, "heavy").otherwise("merge")
    )
    return routes.filter("products > 0").withColumn("form", form)


def adaptive_multiply(a: DataFrame, b: DataFrame, routes: DataFrame, n: int, keep_structural: bool = False,
                      limits: Limits = Limits()) -> DataFrame:
    """Every row in the form its route names; ``routes`` has (r, route) and, from the planner, (runs, products).

    DENSE rows take the tile form. DIRECT rows are scaled rows of B and skip the sum. Heavy
    rows are summed in two stages, the rest in one. The routes already hold the size of each
    class, so the join needs no counting of its own where B is small enough to broadcast.
    """
    if "products" not in routes.columns:
        features = row_features(Matrix(a, n), Matrix(b, n), limits).select("r", "runs", "products")
        routes = stage(routes.select("r", "route").join(features, "r"))
    classes = _classes(routes, limits)
    sizes = {x["form"]: x for x in classes.groupBy("form").agg(
        F.sum("runs").alias("runs"), F.sum("products").alias("products"), F.max("products").alias("longest")).collect()}
    right_rows = b.count()
    forms = classes.select(F.col("r").alias("routed_r"), "form")
    marked = lookup(a, "r", ["c"], forms, "routed_r", limits, n)
    parts = []
    for form, size in sorted(sizes.items()):
        rows = marked.filter(F.col("form") == form).select("r", "c", "v")
        if form == "dense":
            parts.append(dense_multiply(rows, b, keep_structural, limits))
            continue
        shape = None
        if limits.broadcasts(right_rows, b.select("r", "c", "v")):
            shape = JoinShape(size["runs"], right_rows, float(size["products"]), 0, b, size["longest"])
        if form == "merge":
            parts.append(merge_multiply(rows, b, keep_structural, limits, shape))
        elif form == "heavy":
            parts.append(heavy_multiply(rows, b, keep_structural, limits, shape=shape))
        else:
            single = partial_products(rows, b, limits, shape).withColumnRenamed("p", "v")
            parts.append(single if keep_structural else single.filter(F.col("v") != 0))
    if not parts:
        return merge_multiply(a.limit(0), b, keep_structural, limits)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def multiply(a: Matrix, b: Matrix | None = None, mode: str = "auto", keep_structural: bool = False,
             rows: tuple[int | None, int | None] = (None, None),
             columns: tuple[int | None, int | None] = (None, None),
             routes: DataFrame | None = None, calibrated: bool = False,
             limits: Limits = Limits()) -> DataFrame:
    """C = A x B (B defaults to A) as (r, c, v).

    ``rows`` and ``columns`` restrict the output to half-open ranges; both
    filters reach the scans of A and B. ``routes`` overrides the row routes of
    ``adaptive``; ``auto`` takes the mode that the routed work suggests on Spark, or with
    ``calibrated=True`` the one that the validated rule names. The entries of a matrix must be unique
    (``canonical`` makes them so); this is not checked.
    """
    mode = resolve_mode(mode)
    b = b or a
    if mode in ("auto", "adaptive") and routes is None:
        from matrel.plans.light import choose_form, choose_routes

        if calibrated:
            plan = choose_routes(a, b, limits=limits)
            suggested, routes = plan.mode(calibrated), plan.routes
        else:
            suggested, routes = choose_form(a, b, limits=limits)
        mode = suggested if mode == "auto" else mode
    left = a.entries.filter(between("r", *rows))
    right = b.entries.filter(between("c", *columns))
    if mode == "merge":
        return merge_multiply(left, right, keep_structural, limits)
    if mode == "dense":
        return dense_multiply(left, right, keep_structural, limits)
    return adaptive_multiply(left, right, routes, a.n, keep_structural, limits)


def reference_product(a: Matrix, b: Matrix | None = None, limits: Limits = Limits()) -> DataFrame:
    """Structural product with the terms of the rounding bound: (r, c, v, abs_sum, terms)."""
    b = b or a
    shape = join_shape(a.entries, "c", b.entries, "r", limits)
    products = _dealt(partial_products(a.entries, b.entries, limits, shape), shape.partitions(limits), "r", "c")
    return products.groupBy("r", "c").agg(
        F.sum("p").alias("v"), F.sum(F.abs("p")).alias("abs_sum"), F.count(F.lit(1)).alias("terms")
    )


def product_count(a: Matrix, b: Matrix | None = None) -> int:
    """Number of products of A x B, from the key degrees alone."""
    return int(join_shape(a.entries, "c", (b or a).entries, "r").pairs)
