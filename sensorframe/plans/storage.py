"""Where intermediate tables, stream checkpoints and sinks of the catalog live."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: tempfile.TemporaryDirectory | None = None


def drop_dir(spark: SparkSession, path: str) -> None:
    """Delete a directory on whatever file system holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def has_finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` was committed."""
    return exists(spark, f"{path}/_SUCCESS")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory in the cluster's shared folder.

    The folder is ``spark.checkpoint.dir``. Only where that is unset (a single-process
    session, as in tests) is a local temporary folder used, removed at exit; other masters are refused, as executors
    would write to disks of their own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        global _local
        if _local is None:
            _local = tempfile.TemporaryDirectory(prefix="sensorframe-", ignore_cleanup_errors=True)
        root = _local.name
    return f"{root.rstrip('/')}/sensorframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and survives lost executors."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a frame made by :func:`written`; it must not be used afterwards."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop_dir(df.sparkSession, folder)
