"""Candidate pairs from buckets and connected components, as joins and aggregates over edges. DataFrame operations only."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelake.llm.common import durable

#: Buckets up to this size give all their pairs at once.
SMALL_BUCKET = 32
#: Buckets with more members than this outside their largest component get finer keys, where the caller has any: about
#: where rows for each key of a member cost less than holding it against all others, block by block.
VAST_BUCKET = 200_000
#: Stars of a large bucket, each from another member, go on while they join a tenth of what is open; so many at most.
STARS = 8
#: Where more members than MANY_OPEN are still apart, those whose hints differ by no more than this share of what is possible are compared first.
MANY_OPEN, NEAREST = 5_000, 0.8
#: Members of a block in the comparison of large buckets; bounds a task, leaves out nothing. Blocks of members without their texts are WIDE times as large.
BLOCK, WIDE = 1_000, 4
#: Edges are few rows: so many make a task, whatever the number of shuffle partitions.
EDGES_PER_TASK = 100_000


def shared(keys: DataFrame) -> DataFrame:
    """Members (key, id, n) of the buckets of two ids or more, of distinct rows (key, id).

    Counts are combined before they move, and the members of a hot bucket are rows that the adaptive skew join divides.
    """
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return durable(keys.join(sizes.hint("shuffle_hash"), "key").select("key", "id", "n"))


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """Distributed union-find over links (a, b): one row (id, root) for every id of a link, root the least of its component.

    Alternating large-star and small-star steps: every id links its greater neighbours, then its smaller ones, to the
    least it knows, until every id links one least id that links no other (about log n rounds). Least ids are
    combined before they move, and a hub's edges are rows that the adaptive skew join divides; no list of neighbours is
    ever built. Each round is durable. Null ends and loops are left out; no links give no rows.
    """
    now = durable(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def left() -> tuple[int, int]:
        """The number of edges, and of ids that link two others or link one and are linked: none of a forest of stars."""
        ends = now.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up")))).alias("x"))
        seen = ends.groupBy("x.id").agg(F.sum("x.up").alias("up"), F.count("*").alias("n"))
        return seen.agg(F.sum("up"), F.count_if((F.col("up") > 0) & (F.col("n") > 1))).first()

    for step in range(2 * rounds):
        edges, unsettled = left()
        if not unsettled:
            break
        tasks = max(1, math.ceil(edges / EDGES_PER_TASK))
        now = now.coalesce(tasks)
        if step % 2 == 0:  # large star
            both = now.union(now.select("b", "a"))
            least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).coalesce(tasks).select("u", F.least("u", "m").alias("m"))
            moved = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:  # small star
            least = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).coalesce(tasks)
            met = now.join(least, F.col("a") == F.col("u"))
            moved = least.select(F.col("u").alias("a"), F.col("m").alias("b")).union(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = durable(moved.coalesce(tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ends.union(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def _dealt(members: DataFrame, per_block: Column) -> tuple[DataFrame, DataFrame]:
    """Members with their block, and which two blocks of a bucket are to be compared (see `open_pairs`)."""
    groups = members.groupBy("key", "root", "grade").agg(F.count("*").alias("m"))
    sizes = groups.join(groups.groupBy("key", "grade").agg(F.sum("m").alias("n")), ["key", "grade"])
    own = F.col("m") > per_block
    part = F.when(own, F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / per_block))).otherwise(F.pmod(F.xxhash64("root"), F.ceil(F.col("n") / per_block)))
    dealt = durable(members.drop("n").join(sizes, ["key", "root", "grade"]).select("key", "id", "root", "hint", "grade", F.when(own, F.col("root")).alias("own"), part.alias("part"), *(["keys"] if "keys" in members.columns else [])).withColumn("block", F.xxhash64("own", "grade", "part")))
    blocks = dealt.select("key", "block", "own", "grade").distinct()
    other = blocks.select("key", F.col("block").alias("block_b"), F.col("own").alias("own_b"), F.col("grade").alias("grade_b"))
    return dealt, blocks.join(other, "key").where("block <= block_b AND coalesce(own <> own_b, true) AND abs(grade - grade_b) <= 1").select("key", "block", "block_b")


def open_pairs(members: DataFrame, possible: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Pairs (a < b) of different `root` in one bucket, of members (key, id, root, hint, grade) of buckets.

    A bucket of up to WIDE * BLOCK members is compared in one place, so each of its members moves once. Larger ones are
    cut into blocks of about so many, a component of more into its own, and every two blocks of a
    bucket are compared in one place, so a hot bucket is many tasks; blocks of one component are never compared with
    each other, nor are members whose grades differ by over 1. `possible` tells from the hints of two members whether they can be alike at all.
    Two members of several buckets are a pair in that of the least key alone, since all their buckets compare them.
    """
    most, kind = WIDE * BLOCK, members.schema["hint"].dataType
    fields = kind.names if isinstance(kind, StructType) else []  # numbers, as columns of their own: a condition on fields of structs is too long a method to be compiled
    sizes = durable(members.groupBy("key").agg(F.count("*").alias("size")))
    keyed = members.join(members.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("keys")), "id")  # a member's own keys
    large = sizes.where(F.col("size") > most).select("key")
    cut = not large.isEmpty()
    if cut:
        keyed = durable(keyed)  # it is read several times

    def side(rows: DataFrame, name: str, *by: str) -> DataFrame:
        own = {**{c: F.col(c) for c in ("id", "root", "keys")}, **{f: F.coalesce(F.col("hint")[f], F.lit(0)) for f in fields}}
        return rows.select("key", *by, *(c.alias(f"{name}_{f}") for f, c in own.items()))

    apart = F.col("x_root") != F.col("y_root")
    if possible is not None:
        apart &= possible(*({f: F.col(f"{name}_{f}") for f in fields} for name in "xy"))
    apart &= F.get(F.array_intersect("x_keys", "y_keys"), F.lit(0)) == F.col("key")  # in the order of the first, which rises
    few = keyed.join(sizes.where(F.col("size") <= most), "key")
    met = side(few, "x").join(side(few, "y"), "key").where((F.col("x_id") < F.col("y_id")) & apart).select("x_id", "y_id")
    if cut:
        dealt, both = _dealt(keyed.join(large, "key"), F.lit(most))
        left = side(dealt.join(both, ["key", "block"]), "x", "block", "block_b")
        right = side(dealt.withColumnRenamed("block", "block_b").join(both, ["key", "block_b"]), "y", "block", "block_b")
        other = ((F.col("block") != F.col("block_b")) | (F.col("x_id") < F.col("y_id"))) & apart
        met = met.union(left.join(right, ["key", "block", "block_b"]).where(other).select("x_id", "y_id"))
    return met.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct()


def open_blocks(members: DataFrame, per_block: Column) -> DataFrame:
    """The same comparisons without the pairs: rows (key, block, block_b, side, id, root), the members of every two
    blocks that meet, of about `per_block` (an expression of `grade`) members each."""
    dealt, both = _dealt(members, per_block)
    left = dealt.join(both, ["key", "block"]).select("key", "block", "block_b", F.lit(0).alias("side"), "id", "root")
    right = dealt.withColumnRenamed("block", "block_b").join(both, ["key", "block_b"]).where("block <> block_b").select("key", "block", "block_b", F.lit(1).alias("side"), "id", "root")
    return left.union(right)


def joined(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    hints: DataFrame | None = None,
    possible: Callable[..., Column] | None = None,
    refine: Callable[[DataFrame], DataFrame] | None = None,
    meet: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row (id, root) for every id that a verified link joins: the components of all links between ids that share a bucket.

    `members` comes from `shared`; `verify` keeps of pairs (a, b) those that are alike. Small buckets compare all
    pairs, large ones stars first and then every two members that the links found so far do not join: a large family
    costs some stars, and no pair that could join two components is left out. With `refine`, buckets with many members
    outside their largest component give their ids the finer keys (key, id) that it makes of ids (id), which must be
    such that any two alike ids share one, instead; these are compared in the same way. `hints` (id, hint, grade) and `possible`, where given, spare pairs that cannot be alike.
    `meet`, where given, finds the links (a, b) between members (key, id, root, hint, grade) itself, without a row for each pair.
    """
    def first_pairs(rows: DataFrame) -> DataFrame:
        """All pairs of small buckets and a star of each large one."""
        few, many = rows.where(F.col("n") <= SMALL_BUCKET), rows.where(F.col("n") > SMALL_BUCKET)
        left, right = few.select("key", F.col("id").alias("a")), few.select("key", F.col("id").alias("b"))
        every = left.join(right, "key").where("a < b").select("a", "b")
        leads = many.groupBy("key").agg(F.min("id").alias("lead"))
        return every.union(many.join(leads, "key").where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))).distinct()

    def largest(rows: DataFrame, step: int = 0) -> DataFrame:
        """Of each bucket: its largest component, a member of it (of another step another one), and the number of members outside."""
        groups = rows.groupBy("key", "root").agg(F.count("*").alias("m"), F.min_by("id", F.xxhash64("id", F.lit(step))).alias("lead"))
        return durable(groups.groupBy("key").agg(F.max(F.struct("m", "lead", "root")).alias("x"), F.sum("m").alias("n")).select("key", "x.lead", F.col("x.root").alias("most"), (F.col("n") - F.col("x.m")).alias("open")))

    def with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
        return durable(components(roots.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(links)))

    first = durable(first_pairs(members))
    roots = durable(components(verify(first)))
    many = members.where(F.col("n") > SMALL_BUCKET)

    def placed(rows: DataFrame) -> DataFrame:
        """Rows (key, id, n) with the root of each id, of buckets that hold more than one."""
        named = rows.join(roots, "id", "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
        mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return named.join(mixed, "key", "left_semi")

    apart = durable(placed(many))
    if apart.isEmpty():
        return roots
    if refine is not None:
        before = None
        for step in range(STARS):
            leads = largest(apart, step)
            still = leads.agg(F.sum("open")).first()[0]
            if before is not None and still > 0.9 * before:
                break
            before = still
            star = apart.join(leads, "key").where("root <> most").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b"))
            roots = with_links(roots, verify(durable(star.distinct())))
            apart = durable(placed(many))
            if apart.isEmpty():
                return roots
        vast = durable(largest(apart).where(F.col("open") > VAST_BUCKET).select("key"))
        if not vast.isEmpty():
            finer = shared(refine(durable(apart.join(vast, "key", "left_semi").select("id").distinct())))
            more = durable(first_pairs(finer).join(first, ["a", "b"], "left_anti"))
            roots, first = with_links(roots, verify(more)), first.union(more)
            apart = durable(placed(apart.select("key", "id", "n").join(vast, "key", "left_anti").union(finer.where(F.col("n") > SMALL_BUCKET))))

    def with_hints(rows: DataFrame) -> DataFrame:
        return rows.withColumn("hint", F.lit(None).cast("int")).withColumn("grade", F.lit(0)) if hints is None else rows.join(hints, "id")

    if meet is not None:
        return with_links(roots, meet(with_hints(apart)))
    if possible is not None and apart.count() > MANY_OPEN:
        near = durable(open_pairs(with_hints(apart), lambda x, y: possible(x, y, NEAREST)).join(first, ["a", "b"], "left_anti"))
        roots, first = with_links(roots, verify(near)), first.union(near)
        apart = durable(placed(apart.select("key", "id", "n")))
    rest = durable(open_pairs(with_hints(apart), possible).join(first, ["a", "b"], "left_anti"))
    return with_links(roots, verify(rest)) if not rest.isEmpty() else roots
