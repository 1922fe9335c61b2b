"""What to fetch: instruments x timeframes x dates, less what checkpoints cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.functions.scalars import chunk_key, primitive

MONTHLY = ("h1", "h4")


def starts(instruments: DataFrame, timeframes: list[str], checkpoints: DataFrame, date_from: Column | None = None) -> DataFrame:
    """Per instrument and timeframe the first date to fetch: the day after the checkpoint, else the later of history and override.

    Pairs whose fetched timeframe has no start date in the catalogue are left out.
    """
    pairs = instruments.select("*", F.explode(F.array(*map(F.lit, timeframes))).alias("timeframe"))
    known = pairs.withColumn("history", F.col("start_dates")[primitive(F.col("timeframe"))]).where(F.col("history").isNotNull())
    joined = known.join(checkpoints.select("symbol", "timeframe", "last_date"), ["symbol", "timeframe"], "left")
    fresh = F.greatest(F.col("history"), date_from if date_from is not None else F.lit(None).cast("date"))
    return joined.select("symbol", "timeframe", "decimal_factor", F.coalesce(F.date_add("last_date", 1), fresh).alias("start"))


def first_whole_month(start: Column) -> Column:
    return F.when(F.day(start) == 1, start).otherwise(F.add_months(F.trunc(start, "MM"), 1))


def build_plan(instruments: DataFrame, timeframes: list[str], checkpoints: DataFrame, as_of: Column, date_from: Column | None = None, date_to: Column | None = None, partial_first_month: bool = False) -> DataFrame:
    """One row (symbol, timeframe, dt, decimal_factor) per day of ticks and minute bars, per month of hour bars.

    Dates end at `date_to`, or else `as_of`. A month that the start cuts is left out unless `partial_first_month`.
    A catalogue is a small file that few tasks read, so its symbols are spread before they become dates: over all
    shuffle partitions, as few bytes become many rows.
    """
    end = F.least(as_of, date_to) if date_to is not None else as_of
    due = starts(instruments, timeframes, checkpoints, date_from).where(F.col("start") <= end)
    due = due.repartition(int(due.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")
    monthly = F.col("timeframe").isin(*MONTHLY)
    first = F.trunc("start", "MM") if partial_first_month else first_whole_month(F.col("start"))
    dates = F.when(~monthly, F.sequence("start", end, F.expr("interval 1 day"))).when(first <= end, F.sequence(first, end, F.expr("interval 1 month")))
    return due.select("symbol", "timeframe", F.explode(dates).alias("dt"), "decimal_factor")


def chunk_keys(plan: DataFrame) -> DataFrame:
    """One row per physical chunk: 24 hours for a day of ticks, else one; timeframes with one source share its chunks.

    Days and months are made distinct before they become hours and keys, so that no task holds more than its share of these.
    """
    dates = plan.select("symbol", primitive(F.col("timeframe")).alias("primitive"), "dt").distinct()
    hours = F.when(F.col("primitive") == "tick", F.sequence(F.lit(0), F.lit(23))).otherwise(F.array(F.lit(None).cast("int")))
    rows = dates.select("symbol", "primitive", "dt", F.explode(hours).alias("hour"))
    return rows.select("symbol", "primitive", "dt", "hour", chunk_key(F.col("symbol"), F.col("primitive"), F.col("dt"), F.col("hour")).alias("key"))


def workload(years: DataFrame, symbols: DataFrame, week: Column | None = None) -> DataFrame:
    """All chunks of whole years: a month of hour bars, a day of minute bars; and the hours of ticks of the seven days from `week` on."""
    pairs = symbols.select("symbol").crossJoin(F.broadcast(years.select("year")))
    first, last = F.make_date("year", F.lit(1), F.lit(1)), F.make_date("year", F.lit(12), F.lit(31))
    none = F.lit(None).cast("int").alias("hour")
    hours = pairs.select("symbol", F.lit("h1").alias("timeframe"), F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("dt"), none)
    days = pairs.select("symbol", F.lit("m1").alias("timeframe"), F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("dt"), none)
    out = hours.unionByName(days)
    if week is None:
        return out
    ticks = symbols.select("symbol", F.lit("tick").alias("timeframe"), F.explode(F.sequence(week, F.date_add(week, 6))).alias("dt"))
    return out.unionByName(ticks.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))))
