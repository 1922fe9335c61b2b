"""Whitening of vectors: eigenvectors by rank-one updates inside partitions, merged spectra, one distributed refinement."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import durable, fresh, stored

EPS = np.finfo(float).eps
#: Spectra merged by one task.
FAN_IN = 8
#: A component whose share of the largest eigenvalue is no more than this cannot be told from rounding and is left out.
RANK_SHARE = 1e-12
#: Fixed by the contract of the integer vectors: floor(64 c) + 1000000.
SCALE, SHIFT = 64, 1_000_000
FAR = 2.0**56


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho sum z_i^2 / (d_i - x) = 0 for rising, distinct d, non-zero z and rho > 0.

    Root k lies between d_k and d_k+1, the last one within rho |z|^2 above. Each is kept as the nearest pole and an
    offset to it, found by a rational model with both poles that bisection keeps within its bracket, so that the
    differences d_i - x, which make the eigenvectors, are exact to rounding. Returns (origin index, offset).
    """
    n, w = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum() * (1 + 4 * EPS))
    middle = (d + upper) / 2
    f = 1 + (w[None, :] / (d[None, :] - middle[:, None])).sum(1)
    right = (f < 0) & (np.arange(n) < n - 1)  # the root is in the upper half: its origin is the pole above
    origin = np.arange(n) + right
    poles = d[None, :] - d[origin][:, None]
    lo = np.where(right, (d - upper) / 2, np.where(f < 0, (upper - d) / 2, 0.0))
    hi = np.where(right, 0.0, np.where(f < 0, upper - d, (upper - d) / 2))
    low, high = np.arange(n), np.minimum(np.arange(n) + 1, n - 1)
    rows = np.arange(n)
    x = (lo + hi) / 2
    last = rows == n - 1
    below = rows[None, :] <= rows[:, None]
    settled = np.zeros(n, bool)
    for _ in range(100):
        gap = poles - x[:, None]
        terms = w[None, :] / gap
        slopes = terms / gap
        f = 1 + terms.sum(1)
        size = 1 + np.abs(terms).sum(1)
        done = settled | (np.abs(f) <= 2 * EPS * size) | (hi - lo <= EPS * np.abs(x))
        if done.all():
            break
        lo, hi = np.where(f < 0, x, lo), np.where(f >= 0, x, hi)
        # model c + a / (p - y) + b / (q - y): value and both one-sided slopes agree at x
        p, q = gap[rows, low], gap[rows, high]
        s1, s2 = (slopes * below).sum(1), (slopes * ~below).sum(1)
        a, b = s1 * p * p, np.where(last, 0.0, s2 * q * q)
        c = f - s1 * p - np.where(last, 0.0, s2 * q)
        q = np.where(last, 1.0, q)
        # c (p - t)(q - t) + a (q - t) + b (p - t) = 0 for the step t
        with np.errstate(all="ignore"):
            B = -(c * (p + q) + a + b)
            C = c * p * q + a * q + b * p
            root = np.sqrt(np.maximum(B * B - 4 * c * C, 0))
            t = np.where(B > 0, -2 * C / (B + root), 2 * C / (root - B))
            t = np.where(last, p + a / c, t)
        y = x + t
        inside = np.isfinite(y) & (y > lo) & (y < hi)
        settled = inside & (np.abs(t) <= 2 * EPS * np.abs(x))
        x = np.where(done, x, np.where(inside, y, (lo + hi) / 2))
    return origin, x


@dataclass
class Spectrum:
    """Count, mean and scatter Q diag(e) Q' of vectors, kept up to date by rank-one changes; e rises."""

    n: int
    mean: np.ndarray
    e: np.ndarray
    q: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def change(self, v: np.ndarray, rho: float) -> None:
        """Adds rho v v' with rho > 0 to the scatter."""
        norm = np.sqrt(v @ v)
        if norm == 0 or rho <= 0:
            return
        z, rho = (v / norm) @ self.q, rho * norm * norm
        e, q = self.e, self.q
        scale = max(abs(e[-1]), rho)
        # deflation: a component too small to matter leaves its pair as it is; of equal eigenvalues one direction stays
        live = np.flatnonzero(np.abs(z) * rho > 8 * EPS * scale)
        close = np.flatnonzero(np.diff(e[live]) <= 8 * EPS * scale)
        if len(close):
            starts = np.setdiff1d(np.arange(len(live)), close + 1)
            for a, b in zip(starts, np.append(starts[1:], len(live)), strict=True):
                if b - a > 1:  # turn the basis of the group until one vector holds all of z
                    group = live[a:b]
                    part = z[group]
                    length = np.sqrt(part @ part)
                    u = part / length
                    u[-1] += 1.0 if u[-1] >= 0 else -1.0
                    h = 2 / (u @ u)
                    q[:, group] -= np.outer(q[:, group] @ u, h * u)
                    z[group] = 0
                    z[group[-1]] = -length if part[-1] >= 0 else length
            live = np.append(np.setdiff1d(live, live[np.union1d(close, close + 1)]), live[np.setdiff1d(close + 1, close)])
            live.sort()
        if not len(live):
            return
        d, w = e[live], z[live]
        origin, offset = secular(d, w, rho)
        gaps = (d[None, :] - d[origin][:, None]) - offset[:, None]  # root k, pole i: d_i - x_k
        # z for which these roots are exact, so that the vectors stay orthogonal
        k = len(d)
        over, at = -gaps, np.arange(k)
        # prod over j < i of (x_j - d_i) / (d_j - d_i), over j >= i but the last of (x_j - d_i) / (d_j+1 - d_i)
        other = np.where(at[:-1, None] < at[None, :], d[:-1, None] - d[None, :], d[1:, None] - d[None, :])
        exact = np.sqrt(np.abs(np.prod(over[:-1] / other, axis=0) * over[-1] / rho))
        vectors = np.where(w < 0, -exact, exact)[None, :] / gaps
        vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
        q[:, live] = q[:, live] @ vectors.T
        e[live] = d[origin] + offset
        order = np.argsort(e, kind="stable")
        self.e, self.q = e[order], q[:, order]

    def add(self, x: np.ndarray) -> None:
        """One more vector: the scatter about the mean grows by n / (n + 1) times its square about the mean so far."""
        away = x - self.mean
        if self.n:
            self.change(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """The other's eigenpairs and the way between both means, one rank-one change each."""
        if not other.n:
            return
        for value, vector in zip(other.e, other.q.T, strict=True):
            if value > 0:
                self.change(vector, value)
        away, n = other.mean - self.mean, self.n + other.n
        if self.n:
            self.change(away, self.n * (other.n / n))
        self.mean = self.mean + away * (other.n / n)
        self.n = n


def integers(rows: DataFrame, vector: str) -> tuple[DataFrame, str, int]:
    """Rows that can take part, with their integer vectors; the name of that column; the number of dimensions.

    The dimensions are those of the longest vector; a row is dropped if its vector is null, or an entry is null,
    missing, not finite or of 2^56 and more (its integer would not fit into a long).
    """
    (new,) = fresh(rows, "x")
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < FAR))
    d = rows.where(F.col(vector).isNotNull()).agg(F.max(F.size(vector))).first()[0] or 0
    kept = rows.where(F.col(vector).isNotNull() & finite & (F.size(vector) == d))
    return kept.withColumn(new, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + SHIFT)), new, d


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Fixed-length lists of an Arrow column as rows of an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension; only one number for each dimension leaves a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for batch in batches:
            n, total = n + batch.num_rows, total + matrix(batch.column(0), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array(np.append(n, total))], names=["i", "v"])

    found = dict(fit.mapInArrow(run, "i long, v long").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)"))).collect())
    return int(found.get(-1, 0)), [int(found.get(i, 0)) for i in range(d)]


STATE = "slot long, n long, mean array<double>, e array<double>, q array<double>"


def _row(slot: int, s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"slot": [slot], "n": [s.n], "mean": [s.mean], "e": [s.e], "q": [s.q.ravel()]})


def _spectrum(n: int, mean, e, q) -> Spectrum:
    e = np.array(e, float)
    return Spectrum(int(n), np.array(mean, float), e, np.array(q, float).reshape(len(e), len(e)))


def spectrum(fit: DataFrame, d: int, centre: np.ndarray) -> Spectrum:
    """The spectrum of all vectors about `centre`: one of each partition, merged by FAN_IN in rounds, each a Spark job.

    A state is d x (d + 2) numbers; no task holds more than two, and the driver only the last one.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, slot = Spectrum.empty(d), None
        for batch in frames:
            for x in matrix(batch.column(0), d) - centre:
                state.add(x.astype(float))
            slot = batch.column(1)[0].as_py() if batch.num_rows else slot
        if state.n:
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([state.n]), pa.array([state.mean]), pa.array([state.e]), pa.array([state.q.ravel()])], names=["slot", "n", "mean", "e", "q"])

    def merge(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Spectrum.empty(d)
        for frame in frames:
            for r in frame.sort_values("slot").itertuples():
                one = _spectrum(r.n, r.mean, r.e, r.q)
                if one.n > state.n:
                    state, one = one, state
                state.merge(one)
        yield _row(key[0], state)

    states = durable(fit.select("x", F.spark_partition_id().cast("long").alias("slot")).mapInArrow(run, STATE))
    while (left := states.count()) > 1:
        slots = -(-left // FAN_IN)
        numbered = states.withColumn("slot", F.pmod(F.xxhash64("slot", F.lit(left)), F.lit(slots)))
        states = durable(numbered.groupBy("slot").applyInPandas(merge, STATE))
    (last,) = states.collect()
    return _spectrum(last.n, last["mean"], last.e, last.q)


def products(fit: DataFrame, d: int, centre: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Sum over all vectors of y y', y = basis' (x - centre - mean): each task sends its sum of products, added by place."""
    k = basis.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = ((matrix(batch.column(0), d) - centre) - mean) @ basis
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], names=["i", "v"])

    found = dict(fit.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect())
    return np.array([found.get(i, 0.0) for i in range(k * k)]).reshape(k, k)


@dataclass
class Whitener:
    """What `fit` learned: exact count and sums, eigenvalues falling, unit eigenvectors as columns, the largest error."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float


def fit(x: DataFrame, d: int, components: int = 16) -> Whitener:
    """Principal components of the distinct integer vectors in column `x` of `x`.

    Every partition of the distinct vectors follows their scatter by centred rank-one updates; spectra are merged by
    further rank-one updates; one last pass forms the covariance in the basis found (Rayleigh-Ritz) and turns the
    basis by its eigenvectors. A last pass measures the covariance of the whitened vectors. The driver holds d x d numbers.
    Repeated vectors count once, ties of eigenvalues may come in any order, and components whose eigenvalue cannot be
    told from 0 are left out, so one vector or none gives no component.
    """
    if d == 0:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    rows = stored(x.select("x").distinct())
    n, sums = sums_of(rows, d)
    if n < 2:
        return Whitener(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0, 0.0)
    centre = np.array([round(s / n) if abs(s) < 1 << 52 else (2 * s + n) // (2 * n) for s in sums], np.int64)
    mean = np.array([float(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    basis = np.linalg.qr(spectrum(rows, d, centre).q)[0]
    values, turn = np.linalg.eigh(products(rows, d, centre, mean, basis) / n)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], (basis @ turn)[:, order]
    trace = float(values.sum())
    k = int(min(components, (values > RANK_SHARE * max(values[0], 0)).sum())) if values[0] > 0 else 0
    values, vectors = values[:k], vectors[:, :k]
    error = 0.0
    if k:
        error = float(np.abs(products(rows, d, centre, mean, vectors / np.sqrt(values)) / n - np.eye(k)).max())
    return Whitener(n, sums, values, vectors, trace, error)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """Every row that takes part, once for each component: its columns but `vector`, with `component` (from 1), `n`,
    `deviation`, `whitened`, `explained` and `identity_error`; see `integers` for dropped rows and `fit` for the rest.

    `deviation` is exact, or null where it does not fit into a long. An empty table gives no rows. A new column gets a
    trailing `_` where its name is taken.
    """
    ready, x, d = integers(rows, vector)
    learned = fit(ready.select(F.col(x).alias("x")), d, components)
    rest = rows.drop(vector)
    names = fresh(rest, "component", "n", "deviation", "whitened", "explained", "identity_error")
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType())
    schema = T.StructType([*rest.schema.fields, *(T.StructField(a, b) for a, b in zip(names, kinds, strict=True))])
    k, n, sums = len(learned.values), learned.n, np.array(learned.sums, object)
    centre = np.array([s // max(n, 1) for s in learned.sums], np.int64)
    mean = np.array([float(s - n * int(c)) / max(n, 1) for s, c in zip(learned.sums, centre, strict=True)])
    project = learned.vectors / np.sqrt(learned.values) if k else learned.vectors
    explained = learned.values / learned.trace if k else learned.values

    def deviations(m: np.ndarray) -> pa.Array:
        """Sums of squares of n x - S; in longs where none can overflow, else in Python's integers."""
        far = int(max(abs(int(m.max()) - int(centre.min())), abs(int(m.min()) - int(centre.max())))) + 1 if m.size else 0
        if n * far < 1 << 31 and d * (n * far) ** 2 < 1 << 63:
            away = n * (m - centre) - np.array([int(s - n * int(c)) for s, c in zip(sums, centre, strict=True)], np.int64)
            return pa.array((away * away).sum(1))
        exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, sums, strict=True)) for r in m]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            m = matrix(batch.column(batch.num_columns - 1), d)
            y = ((m - centre) - mean) @ project
            row, many = np.repeat(np.arange(len(m)), k), len(m)
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(row)) for c in batch.columns[:-1]), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), many)), pa.array(np.full(many * k, n)), deviations(m).take(pa.array(row)), pa.array(y.ravel()), pa.array(np.tile(explained, many)), pa.array(np.full(many * k, learned.identity_error))],
                names=schema.names,
            )

    return ready.select(*rest.columns, x).mapInArrow(run, schema)
