"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "file:/tmp/checkpoints"
#: Has Spark delete the shuffle files of an action when it ends, not when the driver's JVM collects the plan.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share; a local one only where none is set and the master is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (path or LOCAL_SHARED).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own under the shared folder."""
    return f"{shared_dir(spark)}/foliant-{name}-{uuid.uuid4().hex}"


def at_end(spark: SparkSession, path: str) -> None:
    """Has Hadoop's file system delete a path, wherever it is, when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop's file system, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the actions inside go when each of them ends: for plans that run once."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Deletes the written tables that these are or are made of, once nothing reads them any more."""
    for df in tables:
        own = (re.match(r"(.*/foliant-[^/]+-[0-9a-f]{32})/", f) for f in df.inputFiles())  # no other files go
        for path in {m[1] for m in own if m}:
            remove(df.sparkSession, path)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again; with `by` a folder for each of its values.

    Cuts the lineage so that a lost executor costs one stage, not the whole plan. The files
    go when the application ends, the shuffle files of the writing plan as soon as it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with tidied(spark):
        df.write.parquet(path, partitionBy=by)
    at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
