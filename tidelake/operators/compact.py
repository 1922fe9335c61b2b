"""Deduplication and compaction of append-only chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.sources import files
from tidelake.workspace import parquet_or_empty, staged


def dedup_last(df: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), order: str = "seq") -> DataFrame:
    """Of rows with equal keys the one with the greatest `order`; combined within tasks before any row moves."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))


def merge(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), order: str = "seq", prefer: str = "newest") -> DataFrame:
    """Union of both with one row per key, sorted within partitions.

    `newest` takes the greatest `order`, of equal ones the incoming row; `incoming` and `existing` take the newest
    row of that side if it has one.
    """
    if prefer not in ("newest", "incoming", "existing"):
        raise ValueError("prefer must be newest, incoming or existing")
    rank = F.struct(F.col(order), F.col("_side")) if prefer == "newest" else F.struct(F.col("_side"), F.col(order))
    sides = (existing.withColumn("_side", F.lit(int(prefer == "existing"))), incoming.withColumn("_side", F.lit(int(prefer != "existing"))))
    both = sides[0].unionByName(sides[1])
    rest = [c for c in both.columns if c not in keys and c != "_side"]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row")).select(*keys, *(F.col("_row")[c].alias(c) for c in rest))
    return best.sortWithinPartitions(*keys)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format(F.timestamp_millis("timestamp"), "yyyy_MM"))


def shared_facts(existing: DataFrame, incoming: DataFrame) -> dict[str, object]:
    """The column metadata of both sides' `timestamp`; different decimal factors are an error."""
    old, new = (df.schema["timestamp"].metadata if "timestamp" in df.columns else {} for df in (existing, incoming))
    factors = {d["decimal_factor"] for d in (old, new) if "decimal_factor" in d}
    if len(factors) > 1:
        raise ValueError(f"the table and the incoming rows differ in decimal_factor: {sorted(factors)}")
    return {**new, **old}


def compact(table: str, incoming: DataFrame, keys: tuple[str, ...] = ("symbol", "timestamp"), order: str = "seq", parts: tuple[str, ...] = ("symbol", "month"), prefer: str = "newest") -> DataFrame:
    """Merges `incoming` into the Parquet table at a path and returns the table.

    Only partitions that `incoming` touches are read and written again. The result is staged in full, then replaces
    the touched partitions: a crash before the swap changes nothing, one during it is mended by running again, as
    the incoming rows are still there. Running twice gives the same table. Facts in the column metadata of `timestamp`
    stay, those of the table first.
    """
    spark = incoming.sparkSession
    columns = incoming.columns
    existing = parquet_or_empty(spark, table, incoming)
    touched = incoming.select(*parts).distinct()
    old = existing.select(*columns).join(F.broadcast(touched) if touched.limit(10_001).count() <= 10_000 else touched, list(parts), "left_semi").select(*columns)
    (
        files.with_metadata(staged(merge(old, incoming, keys, order, prefer), "merged"), **shared_facts(existing, incoming))
        .repartition(*parts)
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .option("parquet.compression.codec.zstd.level", "1")
        .partitionBy(*parts)
        .parquet(table)
    )
    return parquet_or_empty(spark, table, incoming).select(*columns)
