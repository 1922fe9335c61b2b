"""Corpus-wide removal of repeated and nearly repeated lines. DataFrame operations only."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import BROADCAST_BYTES, broadcast_if_small, fresh, passing, stored
from tidelake.llm.components import joined, shared

#: Characters of a sketch shingle, and how many of them make a sketch.
LONG, SKETCH = 12, 10
#: Words of so many letters come first in the order in which sketch shingles are taken.
ANCHOR = 6
#: Places of sketch shingles inside words: 8 or more characters into one, so that text without spaces has its own.
INSIDE = rf"(?s)(?<=[^ ]{{8}})(?=([^ ].{{{LONG - 1}}}))"
#: Lines of up to so many sketch shingles have each as a band, lines of at least so many each two neighbours.
SINGLES, PAIRS = 12, 6
#: Lines of up to so many characters also have the first verified shingles as bands, which misses nothing.
TINY = 13
#: Words of 64 parities in the hint of a line, a power of two.
PARITIES = 16


def normal(line: Column) -> Column:
    """Lower case, white space as single spaces, trimmed."""
    odd = [F.contains(line, F.lit(c)) for c in ("  ", "\t", "\r", "\v", "\f")]  # a search costs less than a pattern
    low = F.lower(line)
    return F.trim(F.when(reduce(or_, odd), F.regexp_replace(low, r"\s+", " ")).otherwise(low))


def sketch(line: Column) -> Column:
    """The signature of a normal line: of its sketch shingles the first SKETCH in an order set by hashes, as hashes of 32 bits.

    A sketch shingle is LONG characters, from the start of a word (of four words at most), from any place 8 or more into
    a word, or at the end of the line. Those at words are ordered by a hash of the word, long words first, so only the
    few that are taken are ever made; the others by their own hash.
    """
    low = (1 << 32) - 1
    part = (1 << 30) - 1

    def packed(rank: Column, shingle: Column) -> Column:
        return F.shiftleft(rank, 32).bitwiseOR(F.hash(shingle).cast("long").bitwiseAND(low))

    def own(x: Column) -> Column:
        return packed(F.xxhash64(x).bitwiseAND(part), x)

    def of(w: Column) -> Column:
        ranked = F.transform(w, lambda x, i: F.shiftleft(F.hash(x).cast("long").bitwiseAND(part) + F.when(F.length(x) >= ANCHOR, 0).otherwise(1 << 30), 30).bitwiseOR(i.cast("long")))
        at = F.slice(F.sort_array(ranked), 1, SKETCH)

        def start(x: Column) -> Column:
            i = x.bitwiseAND(part).cast("int")
            return packed(F.shiftright(x, 30), F.substring(F.array_join(F.slice(w, i + 1, 4), " "), 1, LONG))

        inside = F.when(F.exists(w, lambda x: F.length(x) >= LONG + 8), F.transform(F.regexp_extract_all(line, F.lit(INSIDE), F.lit(1)), own)).otherwise(F.array().cast("array<bigint>"))
        taken = F.slice(F.array_distinct(F.sort_array(F.concat(F.transform(at, start), inside, F.array(own(F.substring(line, -LONG, LONG)))))), 1, SKETCH)
        return F.array_distinct(F.transform(taken, lambda x: x.bitwiseAND(low)))

    return F.transform(F.array(F.split(line, " ")), of)[0]  # in a lambda, so that the words are split once


def all_hashes(line: Column, n: int) -> Column:
    """Hashes of 64 bits of the runs of n characters, repeats included."""

    def of(code: Column) -> Column:  # four bytes a character
        return F.transform(F.sequence(F.lit(1), F.length(code) - (4 * n - 1), F.lit(4)), lambda i: F.xxhash64(F.substring(code, i, F.lit(4 * n))))

    return F.when(F.length(line) >= n, F.transform(F.array(F.encode(line, "UTF-32")), of)[0]).otherwise(F.array().cast("array<bigint>"))


def shingle_hashes(line: Column, n: int) -> Column:
    """The distinct ones of `all_hashes`."""
    return F.array_distinct(all_hashes(line, n))


def prefix(size: Column, similarity: float) -> Column:
    """How many first shingles, in any one order, two sets must share one of to reach the similarity."""
    return size - F.ceil(size * F.lit(similarity) - 1e-9).cast("int") + 1


def bands(classes: DataFrame) -> DataFrame:
    """Rows (key, id) of classes (id, a0.., tiny, m): two neighbouring shingles of the sketch are a band, so that a
    common phrase alone makes none; of lines with few sketch shingles each is one, too."""
    low = F.lit((1 << 32) - 1)
    s = [x for c in (f"a{i}" for i in range(SKETCH // 2)) for x in (F.shiftrightunsigned(c, 32), F.col(c).bitwiseAND(low))]
    m = F.col("m")
    keys = [F.when((m <= SINGLES) & (s[i] != 0), F.xxhash64(F.lit(1), s[i])) for i in range(SKETCH)]
    keys += [F.when((m >= PAIRS) & (s[i + 1] != 0), F.xxhash64(F.lit(2), s[i], s[i + 1])) for i in range(SKETCH - 1)]
    t = F.shiftrightunsigned("tiny", 32), F.col("tiny").bitwiseAND(low)
    keys += [F.when(x != 0, F.xxhash64(F.lit(3), x)) for x in t]
    return classes.select("id", F.explode(F.array(*keys)).alias("key")).where("key IS NOT NULL")


def parities(texts: DataFrame, n: int) -> DataFrame:
    """(id, hint) of lines (id, line, copy), one for all copies: the number of distinct shingles and, for each of 64 * PARITIES classes of hashes, whether it holds an odd number of them."""
    each = texts.select("id", "copy", F.explode(shingle_hashes(F.col("line"), n)).alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(PARITIES - 1), F.expr("shiftleft(1L, cast(h & 63 as int))")
    odd = (F.bit_xor(F.when(word == i, bit).otherwise(0)).alias(f"p{i}") for i in range(PARITIES))
    return each.groupBy("id", "copy").agg(F.count("*").cast("int").alias("n"), *odd).dropDuplicates(["id"]).select("id", F.struct("n", *(f"p{i}" for i in range(PARITIES))).alias("hint"))


def rarest(texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Rows (key, id) by which no two alike lines miss each other: the prefix of each line's shingles, the rarest first."""
    each = stored(texts.dropDuplicates(["id"]).select("id", F.explode(shingle_hashes(F.col("line"), n)).alias("h")))
    counted = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h")
    ordered = counted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))  # a line's own shingles
    return ordered.select("id", F.explode(F.slice("s", F.lit(1), prefix(F.size("s"), similarity))).alias("x")).select(F.xxhash64(F.lit(4), "x.h").alias("key"), "id")


def _repeated(docs: DataFrame, similarity: float, shingle_chars: int, min_chars: int) -> DataFrame:
    """Rows (k, h, i) of documents (k, t) that lose lines: the key, the hash of the text and the places of these lines (see `dedup_lines`)."""
    base = docs.where(F.length("t") >= min_chars)
    split = base.select("k", F.xxhash64("t").alias("h"), F.posexplode(F.split("t", "\n")).alias("i", "line"))
    long_enough = F.col("line").rlike(r"\S") if min_chars == 1 else F.length(normal(F.col("line"))) >= min_chars  # the same, but the pattern ends at once
    coded = split.where(long_enough).withColumn("line", normal(F.col("line"))).withColumn("digest", F.unhex(F.md5("line")))
    short = F.sort_array(F.transform(shingle_hashes(F.col("line"), shingle_chars), lambda x: F.hash(x)))
    tiny = F.when(F.length("line") <= TINY, F.slice(short, F.lit(1), prefix(F.size(short), similarity)))
    signed = coded.select("k", "h", "i", "digest", (F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("m"), F.when(F.length("line") >= shingle_chars, sketch(F.col("line"))).alias("s"), tiny.alias("t"))
    lines = stored(signed)

    def two(column: str, at: int) -> Column:
        """Two hashes of 32 bits as one number, 0 for none."""
        x, y = (F.coalesce(F.get(column, F.lit(at + j)), F.lit(0)).cast("long").bitwiseAND((1 << 32) - 1) for j in range(2))
        return F.shiftleft(x, 32).bitwiseOR(y)

    packed = lines.select("digest", F.xxhash64("k", "h", "i").alias("pick"), "m", *(two("s", 2 * i).alias(f"a{i}") for i in range(SKETCH // 2)), two("t", 0).alias("tiny"))
    grouped = packed.groupBy("digest").agg(F.count("*").alias("copies"), F.min("pick").alias("pick"), *(F.first(c).alias(c) for c in packed.columns[2:]))
    classes = stored(grouped.withColumn("id", F.monotonically_increasing_id()))

    members = shared(bands(classes))
    wanted = stored(members.select("id").distinct().join(classes.select("id", "digest", "pick"), "id"))
    met = split.withColumn("pick", F.xxhash64("k", "h", "i")).join(broadcast_if_small(wanted), "pick").withColumn("line", normal(F.col("line")))
    texts = stored(met.where(F.unhex(F.md5("line")) == F.col("digest")).select("id", "line", F.monotonically_increasing_id().alias("copy")))  # repeated rows give copies
    step = 1.0001 * max(math.log(1 / similarity), 0.01)  # sizes of alike lines are at most one grade apart
    hints = stored(parities(texts, shingle_chars).withColumn("grade", F.floor(F.log(F.greatest("hint.n", F.lit(1))) / step).cast("int")))

    def possible(x: Column, y: Column, share: float = 1.0) -> Column:
        """Whether sizes and parities allow the similarity: sets that differ in d shingles differ in at most d parities.
        A lower share asks for so much fewer, which the most alike have."""
        na, nb = x["n"], y["n"]
        differ = sum((F.bit_count(x[f"p{i}"].bitwiseXOR(y[f"p{i}"])) for i in range(PARITIES)), F.lit(0))
        return (F.least(na, nb) >= similarity * F.greatest(na, nb)) & (differ <= share * (1 - similarity) / (1 + similarity) * (na + nb) + 1e-6)

    def of(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of ids in stored pairs; those of few pairs are found where they lie, so the others do not move."""
        few = pairs.count() * 300 <= BROADCAST_BYTES
        return rows.join(F.broadcast(pairs.select(F.explode(F.array("a", "b")).alias("id"))), "id", "left_semi") if few else rows

    def alike(pairs: DataFrame) -> DataFrame:
        known = of(hints.select("id", "hint"), pairs)
        hinted = pairs.join(known.select(F.col("id").alias("a"), F.col("hint").alias("ha")), "a").join(known.select(F.col("id").alias("b"), F.col("hint").alias("hb")), "b")
        near = stored(hinted.where(possible(F.col("ha"), F.col("hb"))).select("a", "b", (F.col("ha.n") + F.col("hb.n")).alias("n")))
        read = of(texts.select("id", "line"), near)
        both = near.join(read.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(read.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
        # m of n - m shingles are shared; each line's hashes occur once here, so that they are made once
        m = F.size(F.array_intersect(all_hashes(F.col("la"), shingle_chars), all_hashes(F.col("lb"), shingle_chars)))
        return both.where(m * (1 + similarity) >= similarity * F.col("n") - 1e-9).select("a", "b").distinct()

    roots = joined(members, alike, hints, possible, lambda ids: rarest(texts.join(ids, "id", "left_semi"), shingle_chars, similarity))
    many = classes.select("id", "digest", "copies").join(roots, "id", "left").where("copies > 1 OR root IS NOT NULL")
    groups = stored(many.select("digest", F.coalesce("root", "id").alias("root")))
    place = F.struct("k", "h", "i")
    held = stored(lines.select("digest", "k", "h", "i").join(broadcast_if_small(groups), "digest").select("root", "k", "h", "i"))
    stays = held.groupBy("root").agg(F.min(place).alias("keep"))
    return held.join(stays, "root").where(place != F.col("keep")).groupBy("k", "h").agg(F.collect_set("i").alias("i"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, shingle_chars: int = 5, min_chars: int = 1) -> DataFrame:
    """Every document with its repeated lines removed, and `n_lines` and `n_dropped`.

    Lines that are equal once lower-cased, with white space as single spaces, and trimmed, or whose sets of
    `shingle_chars`-character shingles have a Jaccard similarity of `similarity` or more, are linked; of each
    connected component one line stays in the corpus, the first by (key, text hash, place). Lines of under `min_chars`
    characters are structure: they always stay; by default only blank ones are.

    Equal lines become one class first, with a number. A class's signature are the first
    SKETCH of its longer character shingles in the order of hashes; bands are neighbours in it (see `bands`,
    `components.joined`): two lines of whose sketch shingles three fifths agree share one with a chance of 0.97. The members of large buckets that
    stars leave open are looked up by the rarest of their verified shingles instead, which loses nothing. Pairs that sizes and shingle parities rule out are
    spared, every other is verified on the shingles of its whole lines (by hashes of 64 bits). Links are joined by
    distributed union-find. A document that loses every line has an empty text; null stays null. Rows of one key and
    text are one document, answered alike. Columns are kept; the new ones get a trailing `_` where their names are taken.
    """
    new = fresh(docs, "n_lines", "n_dropped", "_h", "_k2", "_h2", "_drop")
    with passing(docs.sparkSession):
        drops = stored(_repeated(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), similarity, shingle_chars, min_chars), last=True).toDF(*new[3:])

    keyed = docs.withColumn(new[2], F.xxhash64(text))
    out = keyed.join(drops, keyed[key].eqNullSafe(drops[new[3]]) & (keyed[new[2]] == drops[new[4]]), "left")
    cut = F.split(F.col(text), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(new[5]))
    shorter = F.array_join(F.transform(F.array(cut), lambda c: F.transform(left, lambda i: F.get(c, i)))[0], "\n")
    out = out.withColumn(new[0], F.when(F.col(text).isNotNull(), F.size(cut)).otherwise(0)).withColumn(new[1], F.coalesce(F.size(new[5]), F.lit(0)))
    return out.withColumn(text, F.when(F.col(new[5]).isNull(), F.col(text)).otherwise(shorter)).drop(*new[2:])
