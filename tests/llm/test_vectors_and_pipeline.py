"""Vectors against brute force; the pipeline stage by stage."""

import numpy as np
import pytest

import corpus_pipeline
from tidelake.llm import near_dedup, vector_dedup

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 24))
    x[500:900] = x[3] + rng.normal(size=(400, 24)) * 0.05
    x[900:1000] = x[4]
    x[1000:1100] = x[1100:1200] + rng.normal(size=(100, 24)) * 0.15
    return x


@pytest.mark.parametrize("options", [{}, {"leaf_rows": 60, "task_rows": 120}])
def test_links_equal_brute_force(spark, vectors, options):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **options).collect()}
    x = vectors.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    want = near.sum(1) - 1
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= want).all() and links.sum() >= 0.9 * want.sum()
    root = np.arange(len(x))
    for _ in range(len(x)):
        low = np.where(near, root[None, :], len(x)).min(1)
        if (low == root).all():
            break
        root = low
    assert np.mean([got[i]["component_id"] == root[i] for i in range(len(x))]) > 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_recall_of_planted_near_pairs_without_copies(spark):
    """Pairs of distinct vectors, many just over the limit, scattered over many shards: recall at least 0.9."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 32))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 32)) * np.linspace(0.05, 0.36, 1500)[:, None]
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), leaf_rows=100, task_rows=200).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.95).sum(1) - 1
    links = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 1500 and (links <= want).all() and links.sum() >= 0.9 * want.sum()


@pytest.mark.parametrize("options", [{}])
def test_a_search_that_finds_little_is_noticed(spark, monkeypatch, options):
    """A table with one near pair, and a search that finds nothing: the audit on planted neighbours leads to the exact comparison."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 24))
    x[7] = x[300] + 0.01
    monkeypatch.setattr(vector_dedup, "search", lambda x, graph, radius: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), **options).collect()}
    assert len(got) == 400 and {i for i, v in got.items() if v[0]} == {7, 300} and got[300] == (1, 7)


def test_planted_neighbours():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = (vector_dedup.planted(x, 0.95) * x).sum(1)
    assert (c >= 0.95).all() and (c < 1).all() and (c < 0.96).mean() > 0.3


def test_huge_and_tiny_components(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1e308, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 1.0, 1.0]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, label string, n_links int")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(df).collect())
    assert got == [(i, 0, i, True) for i in range(1, 7)] + [(7, 2, 7, True), (8, 2, 7, False), (8, 2, 7, False), (9, 0, 9, True), (10, 0, 10, True)]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "decontamination", "packing"]
    at, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        at = near_dedup.stored(stage(spark, at, DIR))
        if name != "packing":
            assert at.columns == docs.columns
            counts.append(at.count())
    assert counts == sorted(counts, reverse=True) and counts[1] >= 0.97 * counts[0] and counts[2] == counts[1]
    assert at.select("doc_id").distinct().count() == counts[-1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, DIR).drop("sequence_id", "offset").collect())) == sorted(map(tuple, at.drop("sequence_id", "offset").collect()))
