"""Streams: latest quotes, and compaction of arriving chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.functions.scalars import pct_change
from tidelake.operators.compact import compact
from tidelake.workspace import parquet_or_empty, scratch


def latest_quotes(quotes: DataFrame) -> DataFrame:
    """The newest quote per ticker, with how many there were and the change against the previous close; batch or stream.

    Quotes without a price are left out.
    """
    good = quotes.where(F.col("price").isNotNull() & ~F.isnan("price"))
    best = good.groupBy("ticker").agg(F.max_by(F.struct("price", "previous_close", "ts", "seq"), F.struct("ts", "seq")).alias("q"), F.count("*").alias("n"))
    return best.select("ticker", "q.price", "q.ts", pct_change(F.col("q.price"), F.col("q.previous_close")).alias("change_pct"), "n")


def quote_snapshot(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """The newest row per ticker of what `run_quotes` wrote: the last base and the changes after it."""
    base = parquet_or_empty(spark, f"{out}/base", like.withColumn("epoch", F.lit(-1).cast("long")))
    last = base.agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0]
    changes = parquet_or_empty(spark, f"{out}/changes", like.withColumn("epoch", F.lit(-1).cast("long"))).where(F.col("epoch") > last)
    both = base.where(F.col("epoch") == last).select(*like.columns, F.col("epoch").cast("long")).unionByName(changes.select(*like.columns, F.col("epoch").cast("long")))
    rest = [c for c in like.columns if c != "ticker"]
    return both.groupBy("ticker").agg(F.max_by(F.struct(*rest), "epoch").alias("q")).select("ticker", *(F.col("q")[c].alias(c) for c in rest))


def run_quotes(spark: SparkSession, path: str, schema: T.StructType, out: str | None = None, state: str | None = None, files: int = 4, fold: int = 64) -> DataFrame:
    """Runs `latest_quotes` over the new files of a folder as a stream and returns the snapshot of all so far.

    The state keeps the newest quote of each ticker, so that older ones that arrive later change nothing but the count.
    A batch writes the tickers that it changed, to a folder of its own that a repeated batch replaces; every `fold`
    batches they are folded into a base, so that a snapshot reads one base and less than `fold` batches. With the same `out` and
    `state` a later run goes on where an earlier one ended, or failed.
    """
    out, state = out or scratch(spark, "quotes"), state or scratch(spark, "quotes-state")
    stream = latest_quotes(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path))

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/changes/epoch={epoch}")
        if (epoch + 1) % fold == 0:
            quote_snapshot(spark, out, batch).write.mode("overwrite").parquet(f"{out}/base/epoch={epoch}")

    query = stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    like = spark.createDataFrame([], stream.schema)
    return quote_snapshot(spark, out, like)


def run_compaction(spark: SparkSession, path: str, table: str, schema: T.StructType, keys: tuple[str, ...], order: str, parts: tuple[str, ...]) -> DataFrame:
    """Compacts every file that arrives in a folder into a table, batch by batch; late rows touch their partitions again."""
    columns = schema.names

    def write(batch: DataFrame, epoch: int) -> None:
        compact(table, batch, keys, order, parts)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", scratch(spark, "compaction-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(table).select(*columns)


def bars_stream(ticks: DataFrame, width: str, lateness: str) -> DataFrame:
    """Watermarked tumbling bars of a tick stream with a `time` column."""
    w = F.window("time", width)
    return (
        ticks.withWatermark("time", lateness)
        .groupBy("symbol", w)
        .agg(F.min_by("bid", "time").alias("open"), F.max("bid").alias("high"), F.min("bid").alias("low"), F.max_by("bid", "time").alias("close"), F.sum("bid_vol").alias("volume"))
        .select("symbol", F.unix_millis("window.start").alias("timestamp"), "open", "high", "low", "close", "volume")
    )
