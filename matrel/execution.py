"""Products in tiles that can be resumed: a plan, committed tiles, stored digests, an audit.

A run owns a folder of the shared file system:

* ``plan``     - one row per tile with its row range, column window and work, written once;
* ``tiles``    - the cells of a tile, one sub-folder per attempt;
* ``digests``  - per output row of a tile its length and order-free digests, written beside the cells;
* ``commits``  - an empty file ``<tile>.<attempt>`` per finished tile, or ``<tile>+<n>.<attempt>`` for n tiles from that one on.

A tile counts only once its commit file exists, which is created after cells and digests are
complete. A run that ends between tiles, or inside one, is continued by opening the same folder:
tiles with a commit are skipped, and what an unfinished attempt has left is never read. The plan
holds a digest of both factors, so a folder is not continued with other matrices.

Tiles are cut by work: a tile ends with the row at which the running sum of products passes the
next multiple of the budget, so their number follows the work and not the size of the matrix. The
degrees of the join keys are counted once for all tiles. Where many small tiles are left, neighbours are computed
and committed by one job, since a job costs more than a small tile; a loss then takes at most one such group.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.functions.bits import int_div, lng
from matrel.operators.coo import Matrix, between
from matrel.operators.csr import fingerprints
from matrel.operators.joins import JoinShape, Limits, join_shape, lookup
from matrel.operators.multiply import merge_multiply, multiply, resolve_mode
from matrel.operators.ordered import running
from matrel.operators.profile import row_features
from matrel.session import new_path, stage

PRODUCTS_PER_TILE = 10**11
MAX_TILES = 100_000            # tiles are listed by the driver
GROUPS = 32                    # a run of more tiles is computed in about so many groups of neighbours
_DIGEST = ["row_nnz", "fp_xor", "fp_sum", "fp_values"]


@dataclass(frozen=True)
class Tile:
    begin: int
    end: int
    first_column: int
    last_column: int           # half-open, as the rows
    products: int              # of the row range, all windows
    longest: int               # most products of one row

    @property
    def name(self) -> str:
        return f"r{self.begin}-{self.end}-c{self.first_column}-{self.last_column}"


class _Folder:
    """The few file system calls of a run, made by Hadoop so that any shared folder will do."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._system = self._Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, kind: str) -> list[str]:
        folder = self._Path(f"{self.path}/{kind}")
        return sorted(f.getPath().getName() for f in self._system.listStatus(folder)) if self._system.exists(folder) else []

    def touch(self, name: str) -> None:
        self._system.createNewFile(self._Path(f"{self.path}/{name}"))

    def exists(self, name: str) -> bool:
        return self._system.exists(self._Path(f"{self.path}/{name}"))


def row_tiles(features: DataFrame, n: int, products: int) -> DataFrame:
    """(begin_row, end_row, products, longest): rows dealt to tiles by their running work.

    ``features`` has (r, products) for every row.
    """
    placed = running(stage(features.select("r", "products")), "r", n, {"before": "products"})
    tiles = placed.groupBy(int_div(F.col("before"), products).alias("tile")).agg(
        F.min("r").alias("begin_row"), (F.max("r") + 1).alias("end_row"), F.sum("products").alias("products"), F.max("products").alias("longest"))
    return tiles.select("begin_row", "end_row", "products", "longest")


def matrix_digest(entries: DataFrame) -> str:
    """Order-free digest of the cells."""
    h = F.xxhash64("r", "c", "v")
    found = entries.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h % 1_000_003)).first()
    return "/".join(map(str, found))


def digests(cells: DataFrame) -> DataFrame:
    """(r, row_nnz, fp_xor, fp_sum, fp_values) of a product's rows: structure and values."""
    values = cells.groupBy(F.col("r").alias("_r")).agg(F.bit_xor(F.xxhash64("c", "v")).alias("fp_values"))
    rows = fingerprints(cells)
    return rows.join(values, F.col("r") == F.col("_r")).drop("_r")


class ProductRun:
    """A product of A and B (default A) in tiles below ``folder``; see the module.

    ``products`` is the work of a tile, or ``rows`` its number of rows; ``columns`` cuts each
    row range into column windows of that width. ``mode`` is a form of ``multiply``.
    """

    def __init__(self, a: Matrix, b: Matrix | None = None, folder: str | None = None, products: int = PRODUCTS_PER_TILE,
                 rows: int | None = None, columns: int | None = None, mode: str = "merge", keep_structural: bool = False,
                 limits: Limits = Limits()):
        self.a, self.b, self.mode, self.keep_structural, self.limits = a, b or a, resolve_mode(mode), keep_structural, limits
        self.spark = a.entries.sparkSession
        self.folder = _Folder(self.spark, folder or new_path(self.spark, "product"))
        self.settings = f"products={products} rows={rows} columns={columns} structural={keep_structural}"
        self._shape: JoinShape | None = None
        identity = f"{a.n} {self.b.n} {matrix_digest(a.entries)} {matrix_digest(self.b.entries)} {self.settings}"
        if not self.folder.exists("plan/_SUCCESS"):
            self._plan(products, rows, columns, identity)
        planned = self.spark.read.parquet(f"{self.folder.path}/plan")
        kept = planned.select("identity").first()[0]
        if kept != identity:
            raise ValueError("the folder holds a run of other matrices or settings")
        names = ("begin_row", "end_row", "first_column", "last_column", "products", "longest")
        self.tiles = [Tile(*row) for row in planned.select(*names).orderBy("begin_row", "first_column").collect()]

    def _plan(self, products: int, rows: int | None, columns: int | None, identity: str) -> None:
        features = row_features(self.a, self.b, self.limits)
        if rows is None:
            tiles = row_tiles(features, self.a.n, products)
        else:
            tiles = features.groupBy(int_div(F.col("r"), rows).alias("tile")).agg(
                F.min("r").alias("begin_row"), (F.max("r") + 1).alias("end_row"), F.sum("products").alias("products"), F.max("products").alias("longest"))
        width = columns or self.b.n
        windows = -(-self.b.n // width)
        tiles = stage(tiles)
        if tiles.count() * windows > MAX_TILES:
            raise ValueError(f"more than {MAX_TILES} tiles; raise the work of a tile or the width of a window")
        window = F.explode(F.sequence(lng(0), lng(windows - 1)))
        tiles = tiles.withColumn("window", window).select(
            "begin_row", "end_row", (F.col("window") * width).alias("first_column"),
            F.least((F.col("window") + 1) * width, lng(self.b.n)).alias("last_column"), "products", "longest", F.lit(identity).alias("identity"))
        tiles.coalesce(1).write.mode("overwrite").parquet(f"{self.folder.path}/plan")      # at most MAX_TILES rows

    def committed(self) -> dict[str, str]:
        """Attempt of each finished tile; of two attempts the first by name counts."""
        return {tile: place.rpartition("/")[2] for tile, place in self._places().items()}

    def _places(self) -> dict[str, str]:
        """Sub-folder of each finished tile, its own or that of its group."""
        done: dict[str, str] = {}
        at = {t.name: i for i, t in enumerate(self.tiles)}
        for name in self.folder.names("commits"):
            first, _, attempt = name.rpartition(".")
            tile, _, size = first.partition("+")
            for one in self.tiles[at[tile]:at[tile] + int(size or 1)]:
                done.setdefault(one.name, f"{first}/{attempt}")
        return done

    def _cells(self, tile: Tile) -> DataFrame:
        rows, columns = (tile.begin, tile.end), (tile.first_column, tile.last_column)
        if self.mode != "merge":
            return multiply(self.a, self.b, self.mode, self.keep_structural, rows, columns, limits=self.limits)
        if self._shape is None:
            shape = join_shape(self.a.entries, "c", self.b.entries, "r", self.limits)
            self._shape = replace(shape, degrees=stage(shape.degrees))
        shape = replace(self._shape, pairs=float(tile.products), longest=tile.longest)
        left = self.a.entries.filter(between("r", *rows))
        right = self.b.entries.filter(between("c", *columns))
        return merge_multiply(left, right, self.keep_structural, self.limits, shape)

    def compute(self, tile: Tile) -> None:
        """Write one tile and commit it."""
        attempt = uuid.uuid4().hex
        place = f"{tile.name}/{attempt}"
        self._cells(tile).write.parquet(f"{self.folder.path}/tiles/{place}")
        cells = self.spark.read.parquet(f"{self.folder.path}/tiles/{place}")
        digests(cells).write.parquet(f"{self.folder.path}/digests/{place}")
        self.folder.touch(f"commits/{tile.name}.{attempt}")

    def run(self, most: int | None = None) -> int:
        """Compute the tiles that are not committed, at most ``most``; their number."""
        done = self.committed()
        todo = [t for t in self.tiles if t.name not in done][:most]
        for group in self._groups(todo):
            if len(group) == 1:
                self.compute(group[0])
            else:
                self.compute_group(group)
        return len(todo)

    def _groups(self, todo: list[Tile]) -> list[list[Tile]]:
        """Neighbours of one window that together make no more products than the largest tile by default."""
        size, groups = -(-len(todo) // GROUPS), []
        for tile in todo:
            last = groups[-1] if groups else []
            fits = last and len(last) < size and last[-1].end == tile.begin and last[-1].first_column == tile.first_column
            if fits and sum(t.products for t in last) + tile.products <= PRODUCTS_PER_TILE:
                last.append(tile)
            else:
                groups.append([tile])
        return groups

    def compute_group(self, group: list[Tile]) -> None:
        """Write neighbouring tiles of one window by one job and commit them together."""
        first, last = group[0], group[-1]
        name, attempt = f"{first.name}+{len(group)}", uuid.uuid4().hex
        rows = self.spark.createDataFrame([(t.begin, t.end, t.name) for t in group], "begin long, end long, tile string").select(
            F.explode(F.sequence("begin", F.col("end") - 1)).alias("tile_r"), "tile")
        named = lambda df, identity: lookup(df, "r", identity, rows, "tile_r", self.limits, last.end - first.begin).drop("tile_r")
        whole = Tile(first.begin, last.end, first.first_column, first.last_column,
                     sum(t.products for t in group), max(t.longest for t in group))
        place = f"{name}/{attempt}"
        named(self._cells(whole), ["c"]).write.parquet(f"{self.folder.path}/tiles/{place}")
        cells = self.spark.read.parquet(f"{self.folder.path}/tiles/{place}")
        named(digests(cells), ["r"]).write.parquet(f"{self.folder.path}/digests/{place}")
        self.folder.touch(f"commits/{name}.{attempt}")

    def _read(self, kind: str, partial: bool) -> DataFrame:
        places = self._places()
        if not partial and any(t.name not in places for t in self.tiles):
            raise ValueError("the run is not complete; call run() or ask for the partial result")
        if not places:
            raise ValueError("no tile is committed yet")
        named = F.regexp_extract(F.col("_metadata.file_path"), f"/{kind}/([^/]+)/", 1)
        groups: dict[str, list[Tile]] = {}
        for tile in self.tiles:
            if tile.name in places:
                groups.setdefault(places[tile.name], []).append(tile)
        path = lambda place: f"{self.folder.path}/{kind}/{place}"
        parts = []
        if single := [path(p) for p in groups if "+" not in p]:
            parts.append(self.spark.read.parquet(*single).withColumn("tile", named))
        if whole := [p for p, tiles in groups.items() if "+" in p and f"+{len(tiles)}/" in p]:
            parts.append(self.spark.read.parquet(*map(path, whole)))
        for p, tiles in groups.items():            # another attempt has some tiles of the group
            if "+" in p and p not in whole:
                parts.append(self.spark.read.parquet(path(p)).filter(F.col("tile").isin([t.name for t in tiles])))
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def stored(self, partial: bool = False) -> DataFrame:
        """(r, c, v, tile) of the committed tiles."""
        return self._read("tiles", partial).select("r", "c", "v", "tile")

    def result(self, partial: bool = False) -> DataFrame:
        """The product as (r, c, v)."""
        return self.stored(partial).drop("tile")

    def manifest(self) -> DataFrame:
        """One row per tile of the plan: its range, window, work and whether it is committed."""
        done = self.committed()
        rows = [(t.begin, t.end, t.first_column, t.last_column, t.products, t.longest, t.name in done) for t in self.tiles]
        return self.spark.createDataFrame(rows, "begin_row long, end_row long, first_column long, last_column long, products long, longest long, committed boolean")

    def audit(self, cells: DataFrame | None = None) -> DataFrame:
        """(tile, r, problem) of the stored rows that are not as they were written; the product is not formed again.

        ``cells`` (default: what is stored) are compared with the digests that each tile
        stored: a row is ``missing``, ``foreign`` (never written by its tile), ``repeated`` (each
        cell the same number of times), or ``altered`` (cells lost, added or changed).
        """
        return audit(self._read("digests", partial=True), cells if cells is not None else self.stored(partial=True))


def audit(expected: DataFrame, cells: DataFrame) -> DataFrame:
    """Compare ``cells`` (tile, r, c, v) with stored ``expected`` digests (tile, r, ...)."""
    keyed = cells.withColumn("r", F.struct("tile", "r"))
    found = digests(keyed).select("r.tile", "r.r", *[F.col(x).alias(f"_{x}") for x in _DIGEST])
    both = found.withColumnsRenamed({"tile": "_tile", "r": "_r"}).join(
        expected.select("tile", "r", *_DIGEST), (F.col("_tile") == F.col("tile")) & (F.col("_r") == F.col("r")), "full_outer")
    same = F.lit(True)
    for name in _DIGEST:
        same = same & (F.col(name) == F.col(f"_{name}"))
    # k copies of every cell: lengths and sums k times as large, xors as before or zero
    copies = F.expr("_row_nnz div row_nnz")
    odd = copies % 2
    repeated = (copies > 1) & (F.col("_row_nnz") == copies * F.col("row_nnz")) & (F.col("_fp_sum") == copies * F.col("fp_sum")) & (
        F.col("_fp_xor") == F.col("fp_xor") * odd) & (F.col("_fp_values") == F.col("fp_values") * odd)
    problem = (F.when(F.col("_row_nnz").isNull(), "missing").when(F.col("row_nnz").isNull(), "foreign")
               .when(same, None).when(repeated, "repeated").otherwise("altered"))
    return both.select(F.coalesce("tile", "_tile").alias("tile"), F.coalesce("r", "_r").alias("r"), problem.alias("problem")).filter("problem IS NOT NULL")


def tiled_multiply(a: Matrix, b: Matrix | None = None, rows: int | None = None, columns: int | None = None, **options) -> DataFrame:
    """The product by a run in tiles below a fresh folder; ``options`` go to ``ProductRun``."""
    work = ProductRun(a, b, rows=rows, columns=columns, **options)
    work.run()
    return work.result()
