"""Shared storage for intermediate tables.

Executors can be lost at any time, so anything that is read more than once is
written to the folder named by ``spark.checkpoint.dir``, which every executor
sees, and read back from there.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths written inside each open ``scratch`` block, innermost last.
_open: list[list[str]] = []


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, so Spark and archive writers mean the same place."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; in local mode a temporary one where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return _qualified(spark, found.rstrip("/"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    path = f"{shared_dir(spark)}/driftline-{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a shared Parquet table and return a reader of it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what :func:`staged` and :func:`fresh_path` made inside the block when it ends.

    For blocks that end with all of their results written elsewhere.
    """
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, written; what it wrote on the way is removed, its shuffle files too.

    Spark drops shuffle files when the driver collects the plans they belong to, so that is asked for here.
    """
    path = fresh_path(spark, name)
    with scratch(spark):
        rows = make()
        rows.write.parquet(path)
    schema = rows.schema
    del rows
    spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
