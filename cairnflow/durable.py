"""Intermediate tables in the folder that the driver and all executors share.

What one session writes lies in one folder, named after the application, which is removed when the driver ends; tables that a loop
has replaced are removed at once by ``release``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_noted: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share, as ``spark.checkpoint.dir`` names it. Only a local master may leave it unset:
    elsewhere executors would write to disks of their own, so that raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "cairnflow-shared")


def files_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def run_dir(spark: SparkSession) -> str:
    """This application's own folder, which goes when the driver ends."""
    path = f"{shared_dir(spark)}/cairnflow/{spark.sparkContext.applicationId}"
    if path not in _noted:
        fs, at = files_of(spark, path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _noted.add(path)
    return path


def stash(df: DataFrame, name: str = "part") -> DataFrame:
    """Write a frame to the shared folder and read it again: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def release(df: DataFrame | None) -> None:
    """Remove the files of a stashed frame that nothing will read again; any other frame is left alone."""
    path = getattr(df, "_stashed_at", None)
    if path:
        fs, at = files_of(df.sparkSession, path)
        fs.delete(at, True)


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has ``most_rows`` rows at most, else as it is (a shuffle join follows).

    The frame is counted, so it should be a stashed one of narrow rows."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df
