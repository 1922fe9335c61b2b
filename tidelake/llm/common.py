"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all run on this machine."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tidelake-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


#: With this setting Spark removes the shuffle files of a query as it ends, not once the driver's garbage is collected.
FREES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_passing: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block of an operator that leaves no disk behind: shuffle files of a query inside go as it ends, and what is
    `stored` inside goes with the block, unless it is to `last`. Frames made inside are for one action each; what is
    returned for lazy use is made after the block, from what lasts."""
    before = spark.conf.get(FREES)
    spark.conf.set(FREES, "true")
    _passing.append([])
    try:
        yield
    finally:
        spark.conf.set(FREES, before)
        for path in _passing.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder: lineage is cut, partitions and rows stay fixed, lost executors cost nothing.
    Inside `passing` it is `stored`, as a checkpoint has no path to remove it by."""
    if _passing:
        return stored(df)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, last: bool = False) -> DataFrame:
    """The rows as Parquet in the shared folder; for what is read more than once, or large. See `passing` for `last`."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    if _passing and not last:
        _passing[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A side of a join is broadcast only if its rows, counted first, take no more than this.
BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, row_bytes: int = 120) -> DataFrame:
    """The rows (already stored), marked for broadcast if `row_bytes` for each, in a hashed table, stay under BROADCAST_BYTES."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that do not clash with those of `df` (Spark compares them without case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null gives null, no such run gives an empty array."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_shingles(text: Column, n: int = 5) -> Column:
    """Hashes of all runs of n words, in order, repeats included; empty for fewer than n words."""
    return F.transform(
        F.array(F.transform(words(text), lambda w: F.xxhash64(w))),
        lambda h: F.when(
            F.size(h) >= n,
            F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + k) for k in range(n)))),
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


def salt_count(rows: int, per_salt: int = 20_000, least: int = 64) -> int:
    """Salts so that even a key with all rows is dealt in groups of about `per_salt`; grows with the rows."""
    return max(least, math.ceil(rows / per_salt))
