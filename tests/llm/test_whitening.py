"""Whitening against eigenvectors of the whole covariance, and rank-one updates against the matrices they stand for."""

import numpy as np
import pytest

from tidelake.llm import queries, whitening

DIR = "/root/testdata/sf0.001"


def brute(vectors, components=16):
    x = np.floor(np.asarray(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    away = (n * fit - s) / n
    values, q = np.linalg.eigh(away.T @ away / n)
    values, q = values[::-1], q[:, ::-1]
    y = ((n * x - s) / n) @ q[:, :components] / np.sqrt(values[:components])
    return n, ((n * x - s) ** 2).sum(1), y, values[:components] / values.sum()


def near(got, want):
    """Equal up to each component's sign."""
    sign = np.sign((got * want).sum(0))
    return np.abs(got * sign - want).max()


def pivot(rows, k):
    rows = sorted(rows, key=lambda r: (r["vec_id"], r["component"]))
    return np.array([r["whitened"] for r in rows]).reshape(-1, k), rows


@pytest.mark.parametrize(("d", "n"), [(1, 40), (5, 200), (24, 400), (24, 9)])
def test_updates_and_merges(d, n):
    rng = np.random.default_rng(d)
    x = np.floor(rng.normal(size=(n, d)) * 9)
    x[n // 2 :] = np.roll(x[: n - n // 2], 1, 1)
    one, a, b = whitening.Spectrum.empty(d), whitening.Spectrum.empty(d), whitening.Spectrum.empty(d)
    for i, row in enumerate(x):
        one.add(row)
        (a if i % 3 else b).add(row)
    a.merge(b)
    want = (x - x.mean(0)).T @ (x - x.mean(0))
    for s in (one, a):
        assert s.n == n and np.allclose(s.mean, x.mean(0)) and (np.diff(s.e) >= 0).all()
        assert np.abs((s.q * s.e) @ s.q.T - want).max() <= 1e-12 * np.abs(want).max()
        assert np.abs(s.q.T @ s.q - np.eye(d)).max() < 1e-12


def test_deflation():
    """Equal eigenvalues, changes along an eigenvector, of nothing, and of sizes far apart."""
    s, m = whitening.Spectrum.empty(6), np.zeros((6, 6))
    for v, rho in [(np.eye(6)[0], 1.0), (np.eye(6)[1], 1.0), (np.eye(6)[2], 1.0), (np.ones(6), 2.0), (np.zeros(6), 1.0), (np.eye(6)[0] * 1e-9, 1.0), (np.arange(6.0), 1e-12), (np.ones(6), 1e6)]:
        s.change(v, rho)
        m += rho * np.outer(v, v)
    assert np.abs((s.q * s.e) @ s.q.T - m).max() <= 1e-13 * np.abs(m).max()
    assert np.abs(s.q.T @ s.q - np.eye(6)).max() < 1e-13


def test_equals_the_whole_covariance(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(900, 20)) * np.linspace(1, 3, 20)
    base[300:600] = base[7]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(24)
    got, cells = pivot(whitening.whiten(df).collect(), 16)
    n, deviation, want, explained = brute(base)
    assert len(cells) == 900 * 16 and {r["n"] for r in cells} == {n}
    assert [r["deviation"] for r in cells[::16]] == deviation.tolist()
    assert near(got, want) < 1e-9 and np.allclose([r["explained"] for r in cells[:16]], explained, rtol=1e-10)
    assert 0 <= cells[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in cells}) == 1


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [0.0, 0.0]), (8, [1.0, 0.5]), (8, [1.0, 0.5]), (9, [-2.0, 4.0]), (None, [3.0, -1.0])]
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, N string, x int")
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "N", "x", "component", "n_", "deviation", "whitened", "explained", "identity_error"]
    got = out.where("vec_id IS NOT NULL").collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == sorted((i, c) for i in (7, 8, 8, 9) for c in (1, 2)) and {r["n_"] for r in got} == {4}
    assert out.where("vec_id IS NULL").count() == 2
    want = brute([[0.0, 0.0], [1.0, 0.5], [-2.0, 4.0], [3.0, -1.0]], 2)
    assert {r["vec_id"]: r["deviation"] for r in got} == dict(zip((7, 8, 9), want[1][:3].tolist(), strict=True))
    for few in (df.limit(0), df.where("vec_id = 8"), df.where("vec_id < 7"), df.where("vec_id = 2")):
        assert whitening.whiten(few).count() == 0  # fewer than two distinct vectors vary in nothing
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(line).collect()} == {1}  # directions without spread are left out


def test_entries_far_apart(spark):
    """Deviations that need more than 64 bits on the way are null or exact."""
    df = spark.createDataFrame([(1, [1e9, 1.0]), (2, [-1e9, 2.0]), (3, [1e3, 3.0]), (4, [5e17, 1.0]), (5, [4e16, 1.0])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df.where("vec_id < 4")).where("component = 1").collect()}
    x = [[64 * 10**9 + 10**6, 64 + 10**6], [-64 * 10**9 + 10**6, 128 + 10**6], [64000 + 10**6, 192 + 10**6]]
    s = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert got == {i + 1: v if v < 1 << 63 else None for i, v in enumerate(want)}
    assert None in got.values() and any(v is not None for v in got.values())
    assert {r["vec_id"] for r in whitening.whiten(df).collect()} == {1, 2, 3, 5}


def test_query(spark):
    rows = sorted(spark.read.parquet(f"{DIR}/embeddings.parquet").select("vec_id", "embedding").collect())
    got, cells = pivot(queries.op13_whitening(spark, DIR).collect(), 16)
    n, deviation, want, explained = brute([r[1] for r in rows])
    assert near(got, want) < 1e-8 and [r["deviation"] for r in cells[::16]] == deviation.tolist() and cells[0]["n"] == n
    assert np.allclose([r["explained"] for r in cells[:16]], explained, rtol=1e-9) and cells[0]["identity_error"] < 1e-8
