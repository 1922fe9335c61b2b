"""Folders for intermediate and staged data."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name that driver and executors share: in spark.checkpoint.dir, or a temporary folder where that is unset and all run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidelake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Spark's setting for the most tasks that list folders.
LISTERS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


@contextmanager
def listed(spark: SparkSession) -> Iterator[None]:
    """Inside, folders of what is read are listed by four tasks a core; Spark's default is one a folder up to 10,000, which costs more than the listing."""
    before = spark.conf.get(LISTERS)
    spark.conf.set(LISTERS, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(LISTERS, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to a new folder and read from there, so that nothing before is computed again; none stay none."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parquet_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The Parquet table at a path, or no rows of the columns of `like` where there is none yet."""
    try:
        return spark.read.parquet(path)
    except Exception as missing:
        if not any(c in str(missing) for c in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")):
            raise
        return like.limit(0)
