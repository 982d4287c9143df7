"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="betaloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/betaloom/{name}-{uuid.uuid4().hex}"
    if not _ours:
        atexit.register(_drop_all)
    _ours[path] = spark
    return path


_ours: dict[str, SparkSession] = {}


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`folder`, on whatever file system it lies."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    _ours.pop(path, None)


def _drop_all() -> None:
    for path, spark in list(_ours.items()):
        with contextlib.suppress(Exception):  # the session may have ended before
            drop(spark, path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage where a table is read several times: written once, and no lost executor costs it.

    What isn't discarded before goes when the driver's process ends.
    """
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        drop(df.sparkSession, df._written_to)
