"""Secret scans with linked parts of credentials. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import fresh

#: The base patterns, with the least length of the group that counts.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "secret", "endpoint")
#: Weak candidates: a bare run of 40 characters as secret keys have, and a URL.
WEAK_SECRET = r"[A-Za-z0-9/+]{40,}"
ENDPOINT = r"""https?://[^\s"'<>]+"""

SPANS = "array<struct<start:bigint,rank:int,stop:bigint>>"


#: Matches of one text whose places are added up together.
RUN = 128


def matches(text: Column, pattern: str, keep, rank: int) -> Column:
    """Spans (code points) of the leftmost non-overlapping matches whose text passes `keep`.

    Matches and the gaps between them alternate, so positions are running sums of their lengths. They are added up
    within runs of RUN matches first and then over the runs, so that the time stays in proportion to the matches.
    """

    def steps(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), F.length(m).cast("bigint").alias("n"), keep(m).alias("ok")))

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["g"]
        span = F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + s["n"]).alias("stop"))
        return F.struct((at + s["n"]).alias("at"), F.when(s["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).cast(SPANS).alias("out"))

    def runs(s: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPANS).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(s) / RUN).cast("int") - 1), lambda i: F.aggregate(F.slice(s, i * RUN + 1, F.lit(RUN)), start, step))

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("before"))
        before = F.aggregate(parts, start, lambda acc, r: F.struct((acc["at"] + r["at"]).alias("at"), F.concat(acc["before"], F.array(acc["at"])).alias("before")), lambda acc: acc["before"])
        return F.flatten(F.zip_with(parts, before, lambda r, o: F.transform(r["out"], lambda x: F.struct((x["start"] + o).alias("start"), x["rank"].alias("rank"), (x["stop"] + o).alias("stop")))))

    once = F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    for f in (steps, runs, placed):  # in lambdas, so that each list is made once
        once = F.transform(once, f)
    return F.when(text.rlike(pattern), once[0].cast(SPANS)).otherwise(F.array().cast(SPANS))


def digest(spans: Column) -> Column:
    """`kind:start:end` of the spans by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope_chars: int = 400) -> DataFrame:
    """Every document with its secret spans: `base` (assignments, access identifiers, hex runs) and `linked`.

    Linking takes the parts of a credential together: a weak secret or an endpoint alone says nothing, so they are
    candidates that count only within the scope of their complement, `scope_chars` characters around a part. A weak
    secret is reported if an access identifier is in its scope, an endpoint if an access identifier and a secret
    (weak or assigned) are. Parts meet in an interval join on document and stretch of text, so what a part meets is
    bounded by the scope and not by the document. Only texts with an access identifier enter it.

    Spans are structs (start, rank of the kind in KINDS, stop), code points, stop exclusive, sorted. A null or empty
    text has none. Rows with the same key and text are answered alike; all rows and columns are kept, whatever their
    length; a new column gets a trailing `_` where its name is taken.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    names = fresh(docs, "base", "linked", "_text_key", "_k", "_h", "_linked")
    base = F.concat(
        matches(value, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, 0),
        matches(value, ACCESS, lambda m: F.lit(True), 1),
        matches(value, HEX, lambda m: F.lit(True), 2),
    )
    scanned = docs.withColumn(names[0], F.array_sort(base)).withColumn(names[2], F.xxhash64(value))

    weak = F.concat(
        matches(value, WEAK_SECRET, lambda m: F.length(m) == 40, 3),
        matches(value, ENDPOINT, lambda m: F.lit(True), 4),
    )
    with_access = docs.where(F.col(text).contains("AKIA") & F.col(text).rlike(ACCESS))
    named = F.concat(
        matches(value, ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, 0), matches(value, ACCESS, lambda m: F.lit(True), 1), weak
    )
    one = with_access.select(F.col(key).alias("k"), F.xxhash64(value).alias("h"), named.alias("parts")).groupBy("k", "h").agg(F.first("parts").alias("parts"))
    parts = one.select("k", "h", F.explode("parts").alias("p")).select("k", "h", "p.start", "p.rank", "p.stop")
    cell = F.lit(scope_chars)
    candidates = parts.where("rank IN (3, 4)").select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("start") - cell) / cell)), F.floor((F.col("stop") + cell) / cell))).alias("cell"))
    anchors = parts.where("rank IN (0, 1, 3)").select("k", "h", F.col("start").alias("a_start"), F.col("stop").alias("a_stop"), F.col("rank").alias("a_rank"), F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("stop") / cell))).alias("cell"))
    near = candidates.alias("c").join(
        anchors.alias("a"),
        F.col("c.k").eqNullSafe(F.col("a.k"))
        & (F.col("c.h") == F.col("a.h"))
        & (F.col("c.cell") == F.col("a.cell"))
        & (F.col("a_stop") >= F.col("c.start") - cell)
        & (F.col("a_start") <= F.col("c.stop") + cell)
        & (F.col("a_rank") != F.col("c.rank")),
    )
    linked = (
        near.groupBy("c.k", "c.h", "c.start", "c.rank", "c.stop")
        .agg(F.max(F.col("a_rank") == 1).alias("access"), F.max(F.col("a_rank") != 1).alias("secret"))
        .where(F.col("access") & ((F.col("rank") == 3) | F.col("secret")))
        .groupBy("k", "h")
        .agg(F.array_sort(F.collect_list(F.struct("start", "rank", "stop"))).alias(names[5]))
        .withColumnsRenamed({"k": names[3], "h": names[4]})
    )
    out = scanned.join(linked, scanned[key].eqNullSafe(linked[names[3]]) & (scanned[names[2]] == linked[names[4]]), "left")
    return out.withColumn(names[1], F.coalesce(F.col(names[5]), F.array().cast(SPANS))).drop(*names[2:])
