"""Temporal URL lists: dated entries become validity intervals, captures are judged as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelake.llm.common import broadcast_if_small, durable, fresh

def host(url: Column) -> Column:
    """Lower-case host without user, port, trailing dot and a leading `www.`; null where there is none."""
    authority = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://([^/?#\\]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.regexp_replace(bare, r"\.$", ""), r"^www\.", ""), F.lit(""))


def parent(name: Column) -> Column:
    """A host without its first label; null once fewer than two labels would be left."""
    return F.when(F.size(F.split(name, r"\.")) > 2, F.regexp_replace(name, r"^[^.]+\.", ""))


def domains(name: Column) -> Column:
    """A host and all its parent domains of two labels or more, the most specific first; empty for null."""
    labels = F.split(name, r"\.")
    found = F.transform(F.array(labels), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 1, F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.size(x)), ".")))[0]
    return F.when(name.isNotNull(), found).otherwise(F.array().cast("array<string>"))


def validity(changes: DataFrame) -> DataFrame:
    """Disjoint validity intervals: rows (entry, category, valid_from, valid_to), the end not included.

    `changes` has entry, changed_on (date), action (`add` or `remove`) and category. Each category is a list of its
    own; a `remove` without a category counts for all lists that ever held the entry. Of several changes of an entry in
    a list on one day a `remove` counts, so a day is one change and a history is bounded by its days, not its rows. An
    `add` holds from its day to the day of the next change, open to 9999-12-31. Changes with a null entry or date or an
    unknown action are left out.
    """
    known = changes.where(F.col("entry").isNotNull() & F.col("changed_on").isNotNull() & F.col("action").isin("add", "remove")).select("entry", "category", "changed_on", "action")
    everywhere = F.col("category").isNull() & (F.col("action") == "remove")
    lists = known.where("action = 'add'").select("entry", "category").distinct()
    spread = known.where(everywhere).drop("category").distinct().join(lists, "entry").select("entry", "category", "changed_on", "action")
    daily = known.where(~everywhere).union(spread).groupBy("entry", "category", "changed_on").agg(F.max("action").alias("action"))
    following = F.lead("changed_on").over(Window.partitionBy("entry", "category").orderBy("changed_on"))
    spans = daily.withColumn("valid_to", F.coalesce(following, F.to_date(F.lit("9999-12-31"))))
    return spans.where("action = 'add'").select("entry", "category", F.col("changed_on").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, lists: DataFrame, url: str = "url", fetched_on: str = "fetched_on") -> DataFrame:
    """Every capture with `host`, `blocked` and the list entry active when it was fetched.

    `lists` comes from `validity`. A capture is held against its host and all parent domains of two labels or more; the
    most specific active entry wins, of several lists the first category: entry, category, valid_from and valid_to are
    its, null if none is active. Every (host, day) of the captures is judged once, by an as-of join with the intervals,
    so a host that holds a third of all captures is few rows there; the verdicts then join the captures, broadcast if
    they are small (counted first), else by a shuffle that the adaptive skew join divides. Repeated captures stay as
    they are; a null or relative URL, or a null time, is not blocked. Columns of the captures are kept; a new one gets
    a trailing `_` where its name is taken.
    """
    names = fresh(captures, "host", "blocked", "entry", "category", "valid_from", "valid_to", "_day", "_found", "_h", "_d")
    out = captures.withColumn(names[0], host(F.col(url)))
    days = out.select(F.col(names[0]).alias("h"), F.col(fetched_on).cast("date").alias("d")).where("h IS NOT NULL AND d IS NOT NULL").distinct()
    asked = days.select("h", "d", F.posexplode(domains(F.col("h"))).alias("up", "name"))
    spans = durable(lists.select("entry", "category", "valid_from", "valid_to"))
    met = asked.join(broadcast_if_small(spans), F.col("name") == F.col("entry")).where("d >= valid_from AND d < valid_to")
    order = F.struct("up", F.coalesce("category", F.lit("")), "valid_from")
    best = met.groupBy("h", "d").agg(F.min_by(F.struct("entry", "category", "valid_from", "valid_to"), order).alias(names[7]))
    verdicts = durable(best.withColumnsRenamed({"h": names[8], "d": names[9]}))
    out = out.withColumn(names[6], F.col(fetched_on).cast("date"))
    out = out.join(broadcast_if_small(verdicts, 300), (out[names[0]] == verdicts[names[8]]) & (out[names[6]] == verdicts[names[9]]), "left")
    out = out.withColumn(names[1], F.col(names[7]).isNotNull())
    for name, field in zip(names[2:6], ("entry", "category", "valid_from", "valid_to"), strict=True):
        out = out.withColumn(name, F.col(names[7])[field])
    return out.drop(*names[6:])
