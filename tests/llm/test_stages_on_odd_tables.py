"""Pipeline stages on nulls, empty and long texts, repeats, clashing names and empty tables; brute force for language, sharding and empty sides."""

import math
from collections import Counter

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from tidelake.llm import language, sharding, url_filter
from tidelake.llm.common import stored

DIR = "/root/testdata/sf0.001"
NAMES = ["lang_pred", "score", "accepted", "n_lines", "n_dropped", "kept", "class_id", "piece", "START", "length", "ids", "sequence_id", "k", "t", "id", "h"]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet(f"{DIR}/documents.parquet")
    texts = [None, "", " \n\t", "1234 !?", "xq" * 30_000, "\n\n\n"]
    odd = [(10_000 + i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "A short text of the English kind, with the and of.", "en", "s", 5)] * 2
    return real.unionByName(spark.createDataFrame(odd, real.schema)).select("*", *(F.lit(i).alias(n) for i, n in enumerate(NAMES)))


def test_each_stage_on_odd_rows(spark, docs):
    """Every stage takes the odd rows themselves, not only what the stages before leave of them."""
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, DIR))
        ids = Counter(r[0] for r in out.select("doc_id").collect())
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
        if name == "language":  # null, empty and letterless texts go; no text of the table does in the plain case
            assert not {10_000, 10_001, 10_002, 10_003, 10_005} & set(ids) and ids[None] in (0, 2)
        if name == "line_dedup":  # no row goes, null stays null; blank lines are structure and stay
            kept = {r["doc_id"]: r["text"] for r in out.where("doc_id >= 10000").collect()}
            assert sum(ids.values()) == n and kept[10_000] is None and kept[10_001] == "" and kept[10_002].strip() == "" and kept[10_005] == "\n\n\n" and len(kept[10_004]) == 60_000
        if name in ("near_dedup", "decontamination"):  # texts of under five words equal only their copies and hold no item
            assert {10_000, 10_001, 10_002, 10_003, 10_004, 10_005} <= set(ids)
            assert ids[None] == 2  # rows of one key and text are one document, answered alike
        if name == "packing":  # a row a piece; null and empty are the end id alone
            assert set(out.where("doc_id IN (10000, 10001)").select("length").distinct().collect()) == {(1,)} and ids[None] == 2
            filled = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("m"), F.count("*").alias("c")).collect()
            assert all(r["n"] <= 4096 and r["m"] == r["c"] for r in filled)


def test_each_stage_on_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DIR).count() == 0


def test_language_equals_sizes_by_hand(spark):
    dicts = {"aa": b"kala mina tuko sela vano rimu " * 40, "bb": b"grost blent schwirk drunf plonk " * 40}
    texts = ["Mina, sela KALA tuko!", "blent grost 7 plonk schwirk", "kala blent", "vano " * 900 + "plonk", "é ß", "12", None]
    got = language.classify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string"), dicts).orderBy("doc_id").collect()
    for r, t in zip(got, texts, strict=True):
        data = " ".join("".join(c.lower() if c.isalpha() else " " for c in t or "").split()).encode()
        if not data:
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        for level in (12, 19):
            box = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False) for d in dicts.values()]
            sizes = [sum(len(z.compress(data[i : i + 2000])) for i in range(0, len(data), 2000)) for z in box]
            if sizes[0] != sizes[1]:
                break
        assert r["lang_pred"] == ("aa", "bb")[int(sizes[1] < sizes[0])]
        assert math.isclose(r["score"], 1 / sum(2.0 ** (min(sizes) - s) for s in sizes)) and math.isclose(r["margin"], (max(sizes) - min(sizes)) / max(sizes))


def test_a_row_of_the_matrix_follows_its_exact_law():
    """Partitions of 3, 4 and 5 rows over cells of 5 and 7: the counts of each partition in the first cell are hypergeometric."""
    before, cells, n = np.array([0, 3, 7, 12]), np.array([5, 7]), 6000
    for part, size in enumerate((3, 4, 5)):
        seen = Counter(int(sharding.matrix_row(part, before, cells, seed)[0]) for seed in range(n))
        for k in range(size + 1):
            p = math.comb(5, k) * math.comb(7, size - k) / math.comb(12, size)
            assert abs(seen[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1
    for seed in range(50):
        rows = [sharding.matrix_row(p, before, cells, seed) for p in range(3)]
        assert (sum(rows) == cells).all() and [int(r.sum()) for r in rows] == [3, 4, 5]


def test_no_captures_and_no_lists(spark):
    caps = spark.createDataFrame([], "page_id int, url string, fetched_on date")
    changes = spark.createDataFrame([("x.org", "add", "spam")], "entry string, action string, category string").withColumn("changed_on", F.lit("2024-01-01").cast("date"))
    assert url_filter.judge(caps, url_filter.validity(changes)).count() == 0
    assert url_filter.judge(caps, url_filter.validity(changes.limit(0))).count() == 0
