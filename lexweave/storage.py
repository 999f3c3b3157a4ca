"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where it is unset, one is chosen in local mode alone, as in tests: a cluster's machines share no
    temporary folder, so there it must be set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def fresh_path(spark: SparkSession) -> str:
    """A new path in the shared folder; what is there goes when the session's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/lexweave-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again."""
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def mounted(path: str) -> str:
    """A path of the shared folder as the driver's own file functions know it."""
    return path.removeprefix("file://").removeprefix("file:")
