"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders that this process has taken and not removed.
_taken: list[str] = []


def new_folder(spark: SparkSession) -> str:
    """A folder that isn't there yet, below spark.checkpoint.dir.

    Where that is unset a local session gets one of its own; on a cluster, where each executor would write to a disk of
    its own, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        root = f"{tempfile.gettempdir()}/checkpoints/{os.getpid()}"
    _taken.append(f"{root}/cartolith-{uuid.uuid4().hex}")
    return _taken[-1]


def remove_staged(spark: SparkSession) -> int:
    """Delete all folders that were taken so far, and tell how many: for when results are written and no frame that was
    made from staged tables is used any more."""
    for path in _taken:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    n = len(_taken)
    _taken.clear()
    return n


def staged(df: DataFrame) -> DataFrame:
    """df written out and read back: what several branches use is computed once, and lost executors don't bring it back."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
