"""What came of fetching a chunk, from the log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_outcomes(attempts: DataFrame, keys: list[str], order: list[str], max_absent: int = 2) -> DataFrame:
    """One row per chunk: data, empty, absent or failed.

    The first 200 decides: data, or empty if it has no bytes. Without one, over `max_absent` 404s, or nothing but
    404s, mean absent; anything else failed. `attempts` has status (int) and bytes.
    """
    first = F.min_by("bytes", F.when(F.col("status") == 200, F.struct(*order)))
    got = attempts.groupBy(*keys).agg(
        F.count_if(F.col("status") == 200).alias("n_ok"),
        F.count_if(F.col("status") == 404).alias("n_absent"),
        F.count_if(~F.col("status").isin(200, 404)).alias("n_error"),
        first.alias("bytes"),
    )
    outcome = (
        F.when((F.col("n_ok") > 0) & (F.col("bytes") > 0), "data")
        .when(F.col("n_ok") > 0, "empty")
        .when((F.col("n_absent") > max_absent) | (F.col("n_error") == 0), "absent")
        .otherwise("failed")
    )
    return got.select(*keys, outcome.alias("outcome"), "n_absent", "n_error")


def tallies(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Attempts that brought data, nothing, or an error, and the bytes."""
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempted"),
        F.count_if((F.col("status") == 200) & (F.col("bytes") > 0)).alias("n_data"),
        F.count_if((F.col("status") == 404) | (F.col("status") == 200) & (F.col("bytes") == 0)).alias("n_none"),
        F.count_if(~F.col("status").isin(200, 404)).alias("n_error"),
        F.sum("bytes").alias("bytes_total"),
    )


def log_counters(log: DataFrame, keys: list[str], message: str = "message") -> DataFrame:
    """Retries and re-checks of absent chunks among log messages."""
    return log.groupBy(*keys).agg(F.count_if(F.col(message).contains("retry")).alias("retries"), F.count_if(F.col(message).contains("404")).alias("rechecks"))
