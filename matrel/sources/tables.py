"""Matrices derived from the star-schema tables; all values are integral."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.operators.coo import Matrix, canonical, shifted
from matrel.session import new_path, stage


class Tables:
    """The matrices of one data folder; each is staged once per instance, in the order of its rows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._matrices: dict[str, Matrix] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _size(self, table: str, key: str) -> int:
        return self.table(table).agg(F.max(key)).first()[0] + 1

    def matrix(self, name: str) -> Matrix:
        if name not in self._matrices:
            built, n = getattr(self, f"_{name}")()
            self._matrices[name] = built if isinstance(built, Matrix) else Matrix(stage(built.sortWithinPartitions("r", "c")), n)
        return self._matrices[name]

    def _entries(self, table: str, r, c, v) -> DataFrame:
        rows = self.table(table).select(
            F.col(r).cast("long").alias("r") if isinstance(r, str) else r.cast("long").alias("r"),
            c.cast("long").alias("c"), v.cast("double").alias("v"))
        return canonical(rows.repartitionByRange("r"))       # the one exchange serves the sum and the order

    def _part(self):
        """Parts by hashed order line; ordered quantity. Rows of about 30 scattered entries."""
        n = self._size("part", "p_partkey")
        column = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n
        return self._entries("lineitem", "l_partkey", column, F.col("l_quantity")), n

    def _supp(self):
        """Suppliers by folded part; nearly full rows."""
        n = self._size("supplier", "s_suppkey")
        return self._entries("lineitem", "l_suppkey", F.col("l_partkey") % n, F.col("l_quantity")), n

    def _cust(self):
        """Customers by hashed order; order counts. About ten entries a row."""
        n = self._size("customer", "c_custkey")
        column = (F.col("o_orderkey") * 5 + F.col("o_custkey")) % n
        return self._entries("orders", "o_custkey", column, F.lit(1)), n

    def _sign(self):
        """As cust with +1 for finished orders and -1 otherwise; sums may cancel."""
        n = self._size("customer", "c_custkey")
        column = (F.col("o_orderkey") * 5 + F.col("o_custkey")) % n
        sign = F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)
        return self._entries("orders", "o_custkey", column, sign), n

    def _label(self):
        """Labelled documents by size, and by a hash where toxic or of low quality; many empty rows."""
        n = self._size("documents", "doc_id")
        rows = self.table("labels").join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
        first = rows.select(F.col("doc_id").alias("r"), (F.col("n_chars") % n).alias("c"), (1 + F.col("quality")).alias("v"))
        second = rows.filter((F.col("toxic") == 1) | (F.col("quality") == 0)).select(
            F.col("doc_id").alias("r"), ((F.col("doc_id") * 17 + 5) % n).alias("c"), F.lit(2).alias("v"))
        return canonical(first.unionByName(second)).repartitionByRange("r"), n

    def _trade(self):
        """Customer nation by supplier nation; quantity traded."""
        # Nations, customers and suppliers are joined by key; Spark broadcasts what is small.
        lines = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        customers = self.table("customer").select("c_custkey", "c_nationkey")
        suppliers = self.table("supplier").select("s_suppkey", "s_nationkey")
        joined = (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        )
        rows = joined.select(
            F.col("c_nationkey").cast("long").alias("r"), F.col("s_nationkey").cast("long").alias("c"),
            F.col("l_quantity").alias("v"))
        return canonical(rows).repartitionByRange("r"), self._size("nation", "n_nationkey")

    def _stacked(self, first: str, second: str):
        one, two = self.matrix(first), self.matrix(second)
        n = one.n + two.n
        return Matrix(one.entries.unionByName(shifted(two.entries, one.n, one.n)), n), n      # both are staged already, in this order

    def _mix(self):
        """Block diagonal of supp and part: a dense and a sparse regime."""
        return self._stacked("supp", "part")

    def _blend(self):
        """Block diagonal of supp and cust."""
        return self._stacked("supp", "cust")

    def market_text(self, name: str, symmetry: str = "general", field: str = "real") -> str:
        """Folder with a matrix as Matrix Market text; symmetric forms keep r >= c, ``pattern`` drops the values."""
        matrix = self.matrix(name)
        entries = matrix.entries if symmetry == "general" else matrix.entries.filter(F.col("r") >= F.col("c"))
        lines = entries.select(F.concat_ws(
            " ", (F.col("r") + 1).cast("string"), (F.col("c") + 1).cast("string"),
            F.when(F.lit(field != "pattern"), F.col("v").cast("string"))).alias("value"))
        head = self.spark.createDataFrame(
            [(f"%%MatrixMarket matrix coordinate {field} {symmetry}\n% derived\n\n{matrix.n} {matrix.n} {entries.count()}",)],
            "value string").coalesce(1)
        path = new_path(self.spark, "text")
        head.unionAll(lines).write.text(path)        # the header stays in the first part
        return path
