"""Views of the given tables as ticks, bars, plans, attempts and runs, each with the same rule in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.functions.scalars import scale_price
from tidelake.operators.resample import bars_from_ticks, resample

AS_OF = "2024-01-31"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bid = scale_price(F.col("value"), F.lit(100))
    return e.select(
        F.concat(F.lit("S"), F.col("user_id") % 10).alias("symbol"), F.col("ms").alias("timestamp"), (bid + 1 + F.col("event_id") % 3).cast("int").alias("ask"), bid.alias("bid"),
        F.col("value").cast("float").alias("ask_vol"), (F.col("event_id") % 7).cast("float").alias("bid_vol"), F.col("event_id").alias("seq"),
    )


def dup_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).withColumn("timestamp", F.col("timestamp") - F.col("timestamp") % 900_000)


def tick_bars(spark: SparkSession, sf_dir: str, width_ms: int) -> DataFrame:
    return resample(bars_from_ticks(ticks(spark, sf_dir)), width_ms, order=("seq",))


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    price = scale_price(F.col("l_extendedprice"), F.lit(100)).cast("int")
    return x.select(
        F.concat(F.lit("P"), F.col("l_partkey") % 20).alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("timestamp"), *(price.alias(c) for c in ("open", "high", "low", "close")),
        F.col("l_quantity").cast("float").alias("volume"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as instruments; those of one region have no hour bars, those of another no dates at all."""
    key = F.col("s_suppkey").cast("int")
    region = key % 5
    day = lambda text, step: F.date_add(F.lit(text).cast("date"), region * step)
    dates = F.create_map(F.lit("tick"), day("2024-01-10", 3), F.lit("m1"), day("2023-12-20", 5), F.lit("h1"), F.when(region != 4, day("2023-06-01", 17)))
    return table(spark, sf_dir, "supplier").select(
        F.upper("s_name").alias("symbol"), F.element_at(F.array(*map(F.lit, (1, 100, 1000, 100_000))), (key % 4 + 1).cast("int")).alias("decimal_factor"),
        F.when(region != 3, F.map_filter(dates, lambda k, v: v.isNotNull())).otherwise(F.map_filter(dates, lambda k, v: F.lit(False))).alias("start_dates"),
        F.col("s_name").alias("name"), F.concat(F.lit("Region "), region).alias("description"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    rows = table(spark, sf_dir, "supplier").where(key % 3 == 0).select(F.upper("s_name").alias("symbol"), (key % 25).alias("k"), F.explode(F.array(F.lit("tick"), F.lit("m15"), F.lit("h1"))).alias("timeframe"))
    return rows.select("symbol", "timeframe", F.date_add(F.lit("2024-01-05").cast("date"), F.col("k")).alias("last_date"))


def tick_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol of the ticks: quarter-hour bars on all days of January 2024, four-hour bars of the month."""
    symbols = ticks(spark, sf_dir).select("symbol").distinct()
    days = F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date"))
    fine = symbols.select("symbol", F.lit("m15").alias("timeframe"), F.explode(days).alias("dt"), F.lit(100).alias("decimal_factor"))
    return fine.union(symbols.select("symbol", F.lit("h4").alias("timeframe"), F.lit("2024-01-01").cast("date").alias("dt"), F.lit(100).alias("decimal_factor")))


def user_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user on every day of January 2024."""
    users = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("symbol")).distinct()
    return users.select("symbol", F.lit("tick").alias("timeframe"), F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"))).alias("dt"))


def user_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a user did something; on a day with nothing but errors it failed."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.lit("tick").alias("timeframe"), F.to_date("ts").alias("dt"), "event_type")
    return e.groupBy("symbol", "timeframe", "dt").agg(F.max(F.col("event_type") != "error").alias("ok"))


def user_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 4 = 0")
    return u.select(F.concat(F.lit("U"), "user_id").alias("symbol"), F.lit("tick").alias("timeframe"), F.date_add(F.lit("2023-12-31").cast("date"), (F.col("user_id") % 7).cast("int")).alias("last_date"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts to fetch (user, day): clicks are 404, errors 503, signups an empty 200, others 200 with bytes."""
    kind = F.col("event_type")
    return events(spark, sf_dir).select(
        "user_id", F.to_date("ts").alias("dt"), "ms", "event_id", F.when(kind == "click", 404).when(kind == "error", 503).otherwise(200).alias("status"),
        F.when(kind.isin("click", "error", "signup"), F.lit(0)).otherwise((F.col("value") * 100).cast("bigint")).cast("bigint").alias("bytes"),
        F.when(kind == "click", F.concat(F.lit("404 re-check "), "event_id")).when(kind == "error", F.concat(F.lit("retry after 503 "), "event_id")).otherwise("ok").alias("message"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tries of (user, day) by three systems in two workloads and four rounds; errors retry up to three times, clicks check again."""
    kind, n = F.col("event_type"), F.col("event_id")
    return events(spark, sf_dir).select(
        F.concat(F.lit("sys"), n % 3).alias("system"), F.concat(F.lit("w"), n % 2).alias("workload"), ((n / 6).cast("bigint") % 4).alias("round"), "user_id", F.to_date("ts").alias("dt"),
        kind.isin("view", "purchase").alias("had_data"), kind.isin("click", "signup").alias("empty"), (kind == "error").alias("failed"), (n % 97 + 1).alias("wall_ms"),
        F.when(kind.isin("view", "purchase"), F.col("value").cast("bigint")).otherwise(0).cast("bigint").alias("bytes"), F.when(kind == "error", n % 4).otherwise(0).cast("bigint").alias("retries"), (kind == "click").cast("bigint").alias("rechecks"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as quotes of a ticker per user; every 50th has no price, the previous close follows from the event."""
    price = F.when(F.col("event_id") % 50 != 0, F.col("value"))
    return events(spark, sf_dir).select(F.concat(F.lit("t-"), "user_id", F.lit("=X")).alias("ticker"), price.alias("price"), (F.col("event_id") % 200).cast("double").alias("previous_close"), F.col("ms").alias("ts"), F.col("event_id").alias("seq"))


SQL = r"""
e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events),
ticks AS (
  SELECT 'S' || (user_id % 10) AS symbol, ms AS timestamp, (round_even(value * 100, 0)::INT + 1 + event_id % 3)::INT AS ask, round_even(value * 100, 0)::INT AS bid,
    value::FLOAT AS ask_vol, (event_id % 7)::FLOAT AS bid_vol, event_id AS seq FROM e),
dup_ticks AS (SELECT symbol, timestamp - timestamp % 900000 AS timestamp, ask, bid, ask_vol, bid_vol, seq FROM ticks),
instruments AS (
  SELECT upper(s_name) AS symbol, s_name AS name, 'Region ' || s_suppkey % 5 AS description, ([1, 100, 1000, 100000])[s_suppkey % 4 + 1] AS decimal_factor, (s_suppkey % 5)::INT AS r,
    CASE WHEN r <> 3 THEN date '2024-01-10' + r * 3 END AS start_tick,
    CASE WHEN r <> 3 THEN date '2023-12-20' + r * 5 END AS start_m1,
    CASE WHEN r NOT IN (3, 4) THEN date '2023-06-01' + r * 17 END AS start_h1
  FROM supplier),
checkpoints AS (
  SELECT upper(s_name) AS symbol, t.timeframe, date '2024-01-05' + (s_suppkey % 25)::INT AS last_date FROM supplier, (VALUES ('tick'), ('m15'), ('h1')) t(timeframe) WHERE s_suppkey % 3 = 0),
user_plan AS (
  SELECT u.symbol, 'tick' AS timeframe, (date '2024-01-01' + d::INT) AS dt FROM (SELECT DISTINCT 'U' || user_id AS symbol FROM events) u, range(30) r(d)),
user_outcomes AS (SELECT 'U' || user_id AS symbol, 'tick' AS timeframe, ts::DATE AS dt, bool_or(event_type <> 'error') AS ok FROM events GROUP BY ALL),
user_checkpoints AS (SELECT DISTINCT 'U' || user_id AS symbol, 'tick' AS timeframe, date '2023-12-31' + (user_id % 7)::INT AS last_date FROM events WHERE user_id % 4 = 0),
attempts AS (
  SELECT user_id, ts::DATE AS dt, ms, event_id, CASE event_type WHEN 'click' THEN 404 WHEN 'error' THEN 503 ELSE 200 END AS status,
    CASE WHEN event_type IN ('click', 'error', 'signup') THEN 0 ELSE trunc(value * 100)::BIGINT END AS bytes,
    CASE event_type WHEN 'click' THEN '404 re-check ' || event_id WHEN 'error' THEN 'retry after 503 ' || event_id ELSE 'ok' END AS message FROM e),
runs AS (
  SELECT 'sys' || (event_id % 3) AS system, 'w' || (event_id % 2) AS workload, event_id // 6 % 4 AS round, user_id, ts::DATE AS dt, event_type IN ('view', 'purchase') AS had_data, event_type IN ('click', 'signup') AS empty,
    event_type = 'error' AS failed, event_id % 97 + 1 AS wall_ms, CASE WHEN event_type IN ('view', 'purchase') THEN trunc(value)::BIGINT ELSE 0 END AS bytes, CASE WHEN event_type = 'error' THEN event_id % 4 ELSE 0 END AS retries,
    CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS rechecks FROM events),
quotes AS (
  SELECT 't-' || user_id || '=X' AS ticker, CASE WHEN event_id % 50 <> 0 THEN value END AS price, (event_id % 200)::DOUBLE AS previous_close, ms AS ts, event_id AS seq FROM e)
"""


def bars_sql(source: str, width_ms: int) -> str:
    return f"""SELECT symbol, timestamp - timestamp % {width_ms} AS timestamp, arg_min(bid, (timestamp, seq)) AS open, max(bid) AS high, min(bid) AS low,
      arg_max(bid, (timestamp, seq)) AS close, sum(bid_vol::DOUBLE)::FLOAT AS volume FROM {source} GROUP BY ALL"""
