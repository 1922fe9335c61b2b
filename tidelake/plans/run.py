"""Incremental ingestion: what is planned is decoded, resampled, appended, compacted and checkpointed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.scalars import PRIMITIVE, WIDTH_MS, primitive
from tidelake.operators.compact import compact, with_month
from tidelake.operators.frontier import KEY, frontier, monthly_frontier
from tidelake.operators.resample import resample
from tidelake.plans.ingest import MONTHLY, chunk_keys
from tidelake.sources.chunks import decode_listed, list_chunks
from tidelake.sources.files import append_parquet, tolerant_scan, with_metadata
from tidelake.workspace import staged

PARTS = ("symbol", "month")
KEYS = ("symbol", "timestamp")


def outcomes_of(plan: DataFrame, bad: DataFrame) -> DataFrame:
    """(symbol, timeframe, dt, ok) of a plan: a date is bad if one of the chunks (symbol, primitive, dt) in `bad` is its own."""
    source = primitive(F.col("timeframe"))
    faults = bad.select("symbol", "primitive", "dt").distinct().withColumn("_bad", F.lit(True))
    chunks = plan.select("symbol", "timeframe", "dt").withColumn("primitive", source)
    return chunks.join(faults, ["symbol", "primitive", "dt"], "left").select("symbol", "timeframe", "dt", F.col("_bad").isNull().alias("ok"))


def ingest(spark: SparkSession, plan: DataFrame, chunks: str, lake: str, checkpoints: DataFrame, as_of: Column, version: int, absent_ok: bool = True) -> DataFrame:
    """One run over a plan (symbol, timeframe, dt, decimal_factor); returns all checkpoints, the others as they were.

    The names of the files below the folder `chunks` are listed and joined with the keys of the plan's chunks; only
    those are opened, each once whatever the timeframes it serves, by the tasks that decode them. A chunk that is not there counts as
    empty, or as bad if not `absent_ok`. Bars are resampled to those that are planned. Rows get the run's `version`, are appended to
    `lake`/chunks/TIMEFRAME as they are and merged into `lake`/TIMEFRAME, where the newest version of a row wins: the
    open month, planned again on every run as its checkpoint does not pass it, is refreshed in this way. Checkpoints
    advance over closed days and months up to the first with a chunk that cannot be read. A run that fails is simply run again.
    """
    frames = [r[0] for r in plan.select("timeframe").distinct().collect()]  # at most the five timeframes
    listed = list_chunks(spark, chunks).select("key", "path", "base_ms")
    planned = staged(chunk_keys(plan).withColumnRenamed("primitive", "kind").join(listed, "key", "left"), "planned")
    factors = plan.select("decimal_factor").distinct().limit(2).collect()
    factor = {"decimal_factor": factors[0][0]} if len(factors) == 1 else {}  # several cannot be a fact of one table
    bad = planned.where(F.col("path").isNull() & (not absent_ok)).select("symbol", F.col("kind").alias("primitive"), "dt")
    for source in sorted({PRIMITIVE[f] for f in frames}):
        decoded = staged(decode_listed(planned.where("path IS NOT NULL"), source, keep=("kind", "dt")), "decoded")
        bad = bad.union(decoded.where("error IS NOT NULL").select("symbol", F.col("kind").alias("primitive"), "dt"))
        rows = decoded.where("error IS NULL").drop("error", "path")
        for frame in sorted(f for f in frames if PRIMITIVE[f] == source):
            # a chunk may serve several timeframes, of which each has its own plan
            own = rows.join(plan.where(F.col("timeframe") == frame).select("symbol", "dt"), ["symbol", "dt"], "left_semi").drop("kind", "dt")
            bars = own if frame == source else resample(own, WIDTH_MS[frame])
            fresh = with_metadata(staged(with_month(bars.withColumn("version", F.lit(version))), "fresh"), timeframe=frame, source="ingest", **factor)
            append_parquet(fresh, f"{lake}/chunks/{frame}", PARTS)
            compact(f"{lake}/{frame}", fresh, KEYS, "version", PARTS)
    done = outcomes_of(plan, bad)
    monthly = F.col("timeframe").isin(*MONTHLY)
    days = frontier(plan.where(~monthly & (F.col("dt") < as_of)), done, checkpoints)
    moved = days.union(monthly_frontier(plan.where(monthly), done, checkpoints, as_of))
    kept = checkpoints.select(*KEY, "last_date").join(moved, KEY, "left_anti")
    return moved.union(kept)


def reconstruct(spark: SparkSession, lake: str, symbols: list[str], timeframes: list[str]) -> None:
    """Compacts again all appended chunks of some symbols and timeframes of a lake written by `ingest`, without fetching."""
    for frame in timeframes:
        rows = tolerant_scan(spark, f"{lake}/chunks/{frame}", frame, "version int").where(F.upper("symbol").isin([s.upper() for s in symbols]))
        compact(f"{lake}/{frame}", rows, KEYS, "version", PARTS)
