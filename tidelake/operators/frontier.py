"""Checkpoints that never pass a gap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["symbol", "timeframe"]


def plan_outcomes(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every planned date with `ok`; missing and failed ones are not."""
    good = outcomes.where("ok").select(*KEY, "dt").distinct().withColumn("_ok", F.lit(True))
    return plan.join(good, [*KEY, "dt"], "left").withColumn("ok", F.coalesce("_ok", F.lit(False))).drop("_ok")


def frontier(plan: DataFrame, outcomes: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """New checkpoint per symbol and timeframe: the last planned date before the first bad one.

    Bad first dates keep the old checkpoint (null if none); a checkpoint never moves back.
    """
    known = plan_outcomes(plan, outcomes)
    span = known.groupBy(*KEY).agg(F.min(F.when(~F.col("ok"), F.col("dt"))).alias("bad"), F.max("dt").alias("last"), F.min("dt").alias("first"))
    reached = F.when(F.col("bad").isNull(), F.col("last")).when(F.col("bad") > F.col("first"), F.date_sub("bad", 1))
    joined = span.join(checkpoints.select(*KEY, F.col("last_date").alias("old")), KEY, "left")
    return joined.select(*KEY, F.greatest(reached, F.col("old")).alias("last_date"))


def monthly_frontier(plan: DataFrame, outcomes: DataFrame, checkpoints: DataFrame, as_of: Column) -> DataFrame:
    """As `frontier`, over months (`dt` is a month's first day) that are closed at `as_of`; dates are month ends."""
    closed = plan_outcomes(plan, outcomes).where(F.last_day("dt") < as_of)
    span = closed.groupBy(*KEY).agg(F.min(F.when(~F.col("ok"), F.col("dt"))).alias("bad"), F.max("dt").alias("last"), F.min("dt").alias("first"))
    reached = F.when(F.col("bad").isNull(), F.last_day("last")).when(F.col("bad") > F.col("first"), F.date_sub("bad", 1))
    joined = span.join(checkpoints.select(*KEY, F.col("last_date").alias("old")), KEY, "left")
    return joined.select(*KEY, F.greatest(reached, F.col("old")).alias("last_date"))


def gaps(done: DataFrame, keys: list[str] | None = None, dt: str = "dt") -> DataFrame:
    """Breaks in consecutive dates: the last date before, the next one after, and the days missing between."""
    keys = keys or KEY
    days = done.select(*keys, dt).distinct()
    before = F.lag(dt).over(Window.partitionBy(*keys).orderBy(dt))
    return days.withColumn("after", before).where(F.datediff(dt, "after") > 1).select(*keys, F.col("after").alias("gap_after"), F.col(dt).alias("gap_before"), (F.datediff(dt, "after") - 1).alias("missing"))


def remaining(plan: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Planned dates that the checkpoint does not cover."""
    return plan.join(checkpoints.select(*KEY, "last_date"), KEY, "left").where(F.col("last_date").isNull() | (F.col("dt") > F.col("last_date"))).drop("last_date")


def upsert(checkpoints: DataFrame, changes: DataFrame) -> DataFrame:
    """The newest date per symbol and timeframe, by `version`."""
    both = checkpoints.unionByName(changes)
    return both.groupBy(*KEY).agg(F.max_by("last_date", "version").alias("last_date"), F.max("version").alias("version"))


def progress(checkpoints: DataFrame) -> DataFrame:
    """Earliest year and number of checkpoints per symbol."""
    return checkpoints.groupBy("symbol").agg(F.min(F.year("last_date")).alias("first_year"), F.count("last_date").alias("n"))
