"""Intermediate tables in the shared folder the session names, and size-checked broadcasts."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A broadcast table is held by every executor; above this many rows joins shuffle instead.
BROADCAST_ROWS = 200_000

_FOLDER = "spark.checkpoint.dir"
# Spark removes the shuffle files of a query when it ends; staged tables are what later queries read.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Paths staged in the innermost open scope of this thread.
_staged: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staged", default=None)


def staging_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where a local session names none."""
    folder = spark.conf.get(_FOLDER, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {_FOLDER} to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="leadspark-")
        spark.conf.set(_FOLDER, folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it from there afterwards.

    This cuts lineage (a lost executor recomputes nothing before this point), computes shared work once,
    and gives the optimizer true sizes; being columnar, later reads fetch only the columns they use. The shuffle files of
    the write are removed with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{staging_folder(spark)}/leadspark-{uuid.uuid4().hex}"
    # Set once and left so: another thread's writes rely on it too.
    if spark.conf.get(_CLEANUP, "false") != "true":
        spark.conf.set(_CLEANUP, "true")
    df.write.parquet(path)
    paths = _staged.get()
    if paths is not None:
        paths.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal rows that carry much work each out by ``keys`` over twice the cores, however few bytes they have.

    Without a number of its own adaptive execution merges small partitions, and a few tasks would do the work.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file systems; one that is not there is no error."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(*tables: DataFrame | None) -> None:
    """Remove staged tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path is not None:
            remove_folder(table.sparkSession, path)
            paths = _staged.get()
            if paths is not None and path in paths:
                paths.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope at whose end the tables staged in it are removed, but for those that the function it gives has staged.

    These belong to the scope around it, if there is one. What reads tables of the scope must be staged before it ends.
    """
    outer, inner = _staged.get(), []
    token = _staged.set(inner)

    def keep(df: DataFrame) -> DataFrame:
        table = materialize(df)
        inner.remove(table.staged_path)
        if outer is not None:
            outer.append(table.staged_path)
        return table

    try:
        yield keep
    finally:
        _staged.reset(token)
        for path in inner:
            remove_folder(spark, path)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Materialize a side table and mark it for broadcast only if its counted rows fit the limit."""
    table = materialize(df)
    return F.broadcast(table) if table.count() <= limit else table
