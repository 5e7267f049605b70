"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all of Spark is on this machine (tests), a folder of our own.

    Without the setting a cluster has no folder that all its machines see, so there the missing setting is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is unset, and the machines of {master} need a folder that they share")
        where = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/quernstone-{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df as a written table: computed once, readable after any executor is lost, and gone when the driver's JVM ends."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    hadoop, fs = _path(df.sparkSession, path)
    fs.deleteOnExit(hadoop)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more; rounds call it for the tables of the round before."""
    for table in tables:
        if path := getattr(table, "_stored_at", None):
            hadoop, fs = _path(table.sparkSession, path)
            fs.delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _path(spark, path)
    return fs.exists(hadoop)


def swap_in(spark: SparkSession, new: str, path: str) -> None:
    """The finished table at new takes the place of the one at path, by renaming; see recovered."""
    target, fs = _path(spark, path)
    old, fresh = _path(spark, f"{path}-old")[0], _path(spark, new)[0]
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old) or not fs.rename(fresh, target):
        raise OSError(f"{new} can't be renamed to {path}")
    fs.delete(old, True)


def recovered(spark: SparkSession, path: str) -> None:
    """Ends what a crash in swap_in left: without a table at path the older one comes back."""
    target, fs = _path(spark, path)
    old = _path(spark, f"{path}-old")[0]
    if not fs.exists(target) and fs.exists(old):
        fs.rename(old, target)
