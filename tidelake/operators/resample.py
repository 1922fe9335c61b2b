"""Bars of a coarser width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def bars_from_ticks(ticks: DataFrame, price: str = "bid", volume: str = "bid_vol") -> DataFrame:
    """Every tick as a bar of its own, for `resample`."""
    p = F.col(price)
    return ticks.withColumns({"open": p, "high": p, "low": p, "close": p, "volume": F.col(volume)})


def resample(bars: DataFrame, width_ms: int, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling OHLCV bars, closed and labelled on the left: first open, highest, lowest, last close, summed volume.

    Rows come in time order, ties by `order`; without ties the order key is a plain integer, which keeps the hash
    aggregate. Aggregation combines within tasks first, so a hot symbol moves one row for each bar and task. Bars
    without an open are left out; widths must divide a day, so that the result does not depend on how input is cut.
    """
    if DAY_MS % width_ms:
        raise ValueError("the width must divide a day")
    start = (F.col("timestamp") - F.pmod(F.col("timestamp"), F.lit(width_ms))).alias("timestamp")
    when: Column = F.struct("timestamp", *order) if order else F.col("timestamp")
    return (
        bars.where(F.col("open").isNotNull())
        .groupBy(*keys, start)
        .agg(
            F.min_by("open", when).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", when).alias("close"),
            F.sum(F.col("volume").cast("double")).cast("float").alias("volume"),
        )
    )
