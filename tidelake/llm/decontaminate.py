"""Benchmark decontamination by size-partitioned MinHash containment search. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import BROADCAST_BYTES, durable, fresh, word_shingles


def item_shingles(items: DataFrame, key: str, text: str, share: float) -> DataFrame:
    """The distinct shingles of every test item, with its size, how many of them a match needs, and its MinHash sketch.

    The sketch is the size - need + 1 smallest hashes. A document that holds `need` shingles misses at most
    size - need of them, so it holds one of the sketch for certain: the search loses nothing.
    """
    sets = items.select(F.col(key).alias("item"), F.array_sort(F.array_distinct(word_shingles(F.col(text)))).alias("s")).where(F.size("s") > 0).distinct()
    sized = sets.withColumn("size", F.size("s")).withColumn("need", F.ceil(F.col("size") * F.lit(share) - 1e-9).cast("int"))
    return sized.withColumn("sketch", F.slice("s", F.lit(1), F.col("size") - F.col("need") + 1)).withColumn("part", F.floor(F.log2("size")).cast("int"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = 0.8, row_bytes: int = 150) -> DataFrame:
    """Pairs of documents and test items of whose distinct five-word shingles the document holds `share` or more.

    Items fall into partitions by size (powers of two). Each partition has a ceiling, the greatest sketch hash of its
    items, and a least size; a document looks up a shingle only in those partitions whose items could fit into it and
    whose ceiling is not under the shingle. Hits are candidates; their documents are read again and each pair's shared
    shingles are counted exactly. Sides whose rows, counted first, take at most BROADCAST_BYTES at
    `row_bytes` each are broadcast, larger ones join by shuffle. A document meets an item once, however often it holds the passage.

    Returns key, text_hash (xxhash64 of the text), item_key, n_shared, n_item and containment: a row for each distinct
    (key, text) and item. A null
    text, or one under five words, on either side has no shingles and matches nothing. Repeated items with one key
    and text count once. Other columns of either side, whatever their names, play no part.
    """
    sets = durable(item_shingles(items, item_key, item_text, share))
    parts = sets.groupBy("part").agg(F.min("need").alias("need"), F.max(F.element_at("sketch", -1)).alias("ceiling"), F.sum("size").alias("n"), F.sum(F.size("sketch")).alias("m")).collect()  # at most 32 rows
    kind = docs.schema[key].dataType
    item_kind = items.schema[item_key].dataType
    empty = docs.sparkSession.createDataFrame([], f"{key} {kind.simpleString()}, text_hash bigint, {item_key} {item_kind.simpleString()}, n_shared int, n_item int, containment double")
    if not parts:
        return empty

    def small(rows: int, side: DataFrame) -> DataFrame:
        return F.broadcast(side) if rows * row_bytes <= BROADCAST_BYTES else side

    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    hashed = base.select("k", F.xxhash64("t").alias("h"), word_shingles(F.col("t")).alias("s"))
    ceiling = F.greatest(F.lit(-(2**63)), *(F.when(F.size("s") >= p["need"], F.lit(p["ceiling"])).otherwise(F.lit(-(2**63))) for p in parts))
    low = hashed.where(F.size("s") >= min(p["need"] for p in parts)).withColumn("c", ceiling)
    held_by = F.array(*(F.struct(F.lit(p["part"]).alias("part"), F.lit(p["ceiling"]).alias("ceiling"), F.lit(p["need"]).alias("need")) for p in parts))
    met = low.select("k", "h", F.size("s").alias("n"), F.explode(F.array_distinct(F.filter("s", lambda x: x <= F.col("c")))).alias("x"))
    probes = met.select("k", "h", "n", "x", F.explode(F.filter(held_by, lambda p: (F.col("x") <= p["ceiling"]) & (F.col("n") >= p["need"]))["part"]).alias("part"))
    sketches = sets.select("item", "part", "need", F.explode("sketch").alias("y"))
    hits = probes.join(small(sum(p["m"] for p in parts), sketches.withColumnRenamed("part", "item_part")), (F.col("part") == F.col("item_part")) & (F.col("x") == F.col("y")) & (F.col("n") >= F.col("need")))
    candidates = durable(hits.groupBy("k", "h").agg(F.collect_set("item").alias("items")))

    found = candidates.select(F.col("k").alias("ck"), F.col("h").alias("ch"), "items")
    held_items = found.agg(F.sum(F.size("items"))).first()[0] or 0
    rows = base.join(small(found.count() + held_items, found), F.col("k").eqNullSafe(F.col("ck")) & (F.xxhash64("t") == F.col("ch")))
    held = rows.select("k", "ch", "items", F.explode(F.array_distinct(word_shingles(F.col("t")))).alias("x"))
    full = sets.select("item", "size", "need", F.explode("s").alias("y"))
    shared = held.join(small(sum(p["n"] for p in parts), full), (F.col("x") == F.col("y")) & F.array_contains("items", F.col("item")))
    counted = shared.groupBy("k", "ch", "item", "size", "need").agg(F.countDistinct("x").alias("n")).where(F.col("n") >= F.col("need"))
    return counted.select(F.col("k").alias(key), F.col("ch").alias("text_hash"), F.col("item").alias(item_key), F.col("n").cast("int").alias("n_shared"), F.col("size").alias("n_item"), (F.col("n") / F.col("size")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that contain no test item (see `contained`), each judged by its own text; all columns are kept."""
    (name, digest) = fresh(docs, "_found", "_hash")
    found = contained(docs, items, key, text, **options).select(F.col(key).alias(name), F.col("text_hash").alias(digest)).distinct()
    return docs.join(found, docs[key].eqNullSafe(found[name]) & (F.xxhash64(docs[text]) == found[digest]), "left_anti")
