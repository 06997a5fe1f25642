"""The folder that driver and executors share, and small helpers for work kept there."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new temporary folder in local mode and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path through Spark's file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """What runs inside gives Python at most so many bytes at a time: Spark's own bound of 64 MB is held twice over by each task while it grows."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, most)
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def kept(df: DataFrame, what: str) -> tuple[DataFrame, str]:
    """Writes df to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, what)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Estimates above this are Catalyst's way to say that it doesn't know, or products of joined sizes
KNOWN_BYTES = 1 << 50
ROW_BYTES = 4096


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a DataFrame's size, known without reading it; where it has none, its rows are counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < KNOWN_BYTES else df.count() * ROW_BYTES


def local_path(path: str) -> str:
    """The path of a shared folder that all machines mount, for memory-mapped files."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {path}")
    return path
