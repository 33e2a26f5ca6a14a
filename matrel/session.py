"""Session settings and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"     # Spark 4.1; others ignore it
# Readers take 4096 rows of a row group at once, and writers look at the size of a page after this many.
_FEW_AT_ONCE = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "8"}
_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def local_session(cores: str = "8", memory: str = "16g", app: str = "matrel") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster a
    machine-local path would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="matrel-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder; all paths of an application share one parent."""
    return f"{shared_folder(spark)}/matrel-{spark.sparkContext.applicationId}/{kind}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, lets several consumers share one computation, and gives
    the optimizer the true size of the table. The shuffle files of the
    computation go with it, not when the driver happens to collect its garbage.
    ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = new_path(spark, "stage")
    before = spark.conf.get(_SHUFFLES_GO, "false")
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_SHUFFLES_GO, before)
    if (paths := _scope.get()) is not None:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def stage_values(df: DataFrame) -> DataFrame:
    """``stage`` for a table of large values, in small row groups."""
    return stage(df, **_FEW_AT_ONCE)


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote for ``df``; frames that read it are then void."""
    _delete(df.sparkSession, [df.staged_at])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside are deleted at the end, but for those given to the function that is yielded."""
    paths, kept = [], []
    outer = _scope.set(paths)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.staged_at)
        return df

    try:
        yield keep
    finally:
        _scope.reset(outer)
        if (above := _scope.get()) is not None:
            above += kept
        _delete(spark, [x for x in paths if x not in kept])


def release(spark: SparkSession) -> None:
    """Delete everything this application has staged; frames that read it are then void."""
    _delete(spark, [f"{shared_folder(spark)}/matrel-{spark.sparkContext.applicationId}"])
