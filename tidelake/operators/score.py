"""Scores of ingestion strategies: completeness, silent gaps, stability and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


MEASURES = ("wall_ms", "attempted", "n_ok", "n_none", "n_error", "bytes", "retries", "rechecks")


def hits(runs: DataFrame, chunk: list[str]) -> DataFrame:
    """(system, workload, chunk): what a system got data for in any round."""
    return runs.where("had_data").select("system", "workload", *chunk).distinct()


def ground_truth(runs: DataFrame, chunk: list[str]) -> DataFrame:
    """(workload, chunk): what any system ever got data for."""
    return runs.where("had_data").select("workload", *chunk).distinct()


def in_truth(found: DataFrame, truth: DataFrame, chunk: list[str]) -> DataFrame:
    """Per system and workload how many chunks it found that are in the truth, and how many are not."""
    known = truth.select("workload", *chunk).distinct().withColumn("_known", F.lit(True))
    return found.distinct().join(known, ["workload", *chunk], "left").groupBy("system", "workload").agg(F.count("_known").alias("hits"), F.count_if(F.col("_known").isNull()).alias("unknown"))


def silent_gaps(runs: DataFrame, chunk: list[str]) -> DataFrame:
    """Chunks of a workload's ground truth that a system which ran the workload never got."""
    ran = runs.select("system", "workload").distinct()  # a row for each pair of names
    return ground_truth(runs, chunk).join(ran, "workload").join(hits(runs, chunk), ["system", "workload", *chunk], "left_anti")


def round_means(runs: DataFrame, keys: list[str], measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Per system and workload the means over rounds of what each round adds up to; `runs` has a `round` and the measures."""
    per = runs.groupBy(*keys, "round").agg(*(F.sum(m).alias(m) for m in measures))
    return per.groupBy(*keys).agg(F.count("*").alias("rounds"), *(F.avg(m).alias(m) for m in measures))


def scoreboard(runs: DataFrame, chunk: list[str]) -> DataFrame:
    """Per system and workload: means over the rounds, completeness and gaps against the workload's own ground truth,
    instability and throughput.

    `runs` has a row for each chunk that a system tried in a round: had_data, empty, failed, wall_ms, bytes, retries,
    rechecks. `attempted` counts the first round; instability is errors and retries over it, throughput chunks a second.
    """
    count = lambda c: F.count_if(c)
    rounds = runs.groupBy("system", "workload", "round").agg(
        F.count("*").alias("attempted"), count("had_data").alias("n_ok"), count("empty").alias("n_none"), count("failed").alias("n_error"), *(F.sum(m).alias(m) for m in ("wall_ms", "bytes", "retries", "rechecks")),
    )
    means = rounds.groupBy("system", "workload").agg(F.count("*").alias("rounds"), F.min_by("attempted", "round").alias("attempted"), *(F.avg(m).alias(m) for m in MEASURES if m != "attempted"))
    found = hits(runs, chunk)
    got = found.groupBy("system", "workload").agg(F.count("*").alias("hit"))
    truth = found.select("workload", *chunk).distinct().groupBy("workload").agg(F.count("*").alias("n_truth"))
    out = means.join(got, ["system", "workload"], "left").join(truth, "workload", "left").fillna(0, ["hit", "n_truth"])  # a row a workload
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return out.select(
        "system", "workload", "rounds", *MEASURES,
        (F.col("hit") / F.greatest("n_truth", F.lit(1))).alias("completeness"), (F.col("n_truth") - F.col("hit")).alias("gaps"),
        over(F.col("n_error") + F.col("retries"), F.col("attempted")).alias("instability"), over(F.col("attempted") * 1000, F.col("wall_ms")).alias("throughput"),
    )


def verdict(scores: DataFrame) -> DataFrame:
    """Over the workloads: sums of all counts and times and of the gaps, means of the ratios, the most rounds."""
    means = ("completeness", "instability", "throughput")
    return scores.groupBy("system").agg(F.max("rounds").alias("rounds"), *(F.sum(c).alias(c) for c in (*MEASURES, "gaps")), *(F.avg(c).alias(c) for c in means))


def rank(scores: DataFrame) -> DataFrame:
    """Systems by completeness, then fewer gaps, stability and throughput, then name; rank 1 wins."""
    order = (F.round("completeness", 6).desc(), F.col("gaps").asc(), F.round("instability", 6).asc(), F.col("throughput").desc(), F.col("system").asc())
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(*order)))  # a row per system


def running_rows(daily: DataFrame, keys: list[str], dt: str = "dt", n: str = "n") -> DataFrame:
    """Rows by day with the total so far."""
    return daily.withColumn("total", F.sum(n).over(Window.partitionBy(*keys).orderBy(dt).rowsBetween(Window.unboundedPreceding, 0)))


def growth_ratio(series: DataFrame, keys: list[str], dt: str = "dt", cost: str = "cost") -> DataFrame:
    """Last over first cost, and whether cost grows with the days: from 0.6 a day on; null for a first cost near 0."""
    ends = series.groupBy(*keys).agg(F.min_by(cost, dt).alias("first_cost"), F.max_by(cost, dt).alias("last_cost"), F.count("*").alias("n_days"))
    ratio = F.when(F.col("first_cost") > 1e-3, F.col("last_cost") / F.col("first_cost"))
    return ends.withColumn("ratio", ratio).withColumn("grows", F.col("ratio") >= 0.6 * F.col("n_days"))
