"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelake.llm.common import durable, fresh

NUMPY_LIMIT = 10**9 - 1


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good items among `draws` from good + bad. Numpy serves up to 10^9 items; beyond that, ratio-of-uniforms rejection."""
    total = good + bad
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if draws == total:
        return good
    if total <= NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    lo, hi = max(0, draws - bad), min(good, draws)

    def log_p(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))

    mean = draws * good / total
    spread = math.sqrt(max(mean * (1 - good / total) * (total - draws) / (total - 1), 0.25))
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    top, width = log_p(mode), 2.0 * (spread + 1)
    while True:
        u, v = rng.random(), rng.random()
        if u == 0:
            continue
        k = math.floor(mean + width * (2 * v - 1) / u + 0.5)
        if lo <= k <= hi and 2 * math.log(u) <= log_p(k) - top:
            return k


def _split(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of `draws` items, drawn without replacement, come from each cell of the given sizes."""
    total = int(sizes.sum())
    if total <= NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(sizes, draws, method="marginals")
    out = np.zeros_like(sizes)
    for j, size in enumerate(sizes.tolist()):
        total -= size
        out[j] = _hypergeometric(rng, size, total, draws)
        draws -= int(out[j])
    return out


def matrix_row(part: int, before: np.ndarray, cells: np.ndarray, seed: int) -> np.ndarray:
    """Row `part` of the communication matrix: exact counts that input partition `part` sends to each cell.

    `before[i]` counts the rows of partitions under i; `cells` has the exact cell sizes. The matrix is never
    materialised: halving the partitions from the root to the leaf, each node draws how its cells' items divide
    between both halves, from a generator seeded by the node, so that every task agrees on the shared nodes.
    """
    lo, hi = 0, len(before) - 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _split(np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi]))), cells, int(before[mid] - before[lo]))
        cells, lo, hi = (left, lo, mid) if part < mid else (cells - left, mid, hi)
    return cells


def shuffle_into_shards(df: DataFrame, n_shards: int = 40, seed: int = 20_24, cell_rows: int = 250_000, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Every row with its `shard` (0..n_shards-1) and its `slot` there (gapless from 0): a uniform random permutation.

    Shard sizes differ by one row at most and are known before any row moves. Shards are divided into cells of about
    `cell_rows`; each input partition draws its exact counts per cell, deals its own rows at random by them, rows are
    exchanged by cell and permuted again inside it. One exchange; a cell is sorted in one task,
    however large a shard (a task may get several cells, one after the other).

    All columns are kept (`shard` and `slot` get a trailing `_` where taken). Null values, repeated rows and any
    texts are rows like others. An empty input gives no rows; with fewer rows than shards some shards are empty.
    The input is checkpointed first, so that counts and rows agree whichever executors are lost.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    base = durable(df)
    part, cell, start, key = fresh(base, "_part", "_cell", "_start", "_key")
    out_shard, out_slot = fresh(base, shard, slot)
    dealt = base.withColumn(part, F.spark_partition_id())
    counts = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # a number for each input partition
    before = np.concatenate([[0], np.cumsum([counts.get(i, 0) for i in range(max(counts, default=-1) + 1)], dtype=np.int64)]).astype(np.int64)
    rows = int(before[-1])
    per = max(1, math.ceil(rows / n_shards / cell_rows))
    shards = np.array([rows // n_shards + (j < rows % n_shards) for j in range(n_shards)], dtype=np.int64)
    cells = np.array([m // per + (c < m % per) for m in shards.tolist() for c in range(per)], dtype=np.int64)
    starts = (np.cumsum(cells.reshape(n_shards, per), axis=1) - cells.reshape(n_shards, per)).ravel()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rng, at = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if labels is None:
                own = batch.column(batch.schema.get_field_index(part))[0].as_py()
                labels = np.repeat(np.arange(len(cells), dtype=np.int32), matrix_row(own, before, cells, seed))
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, own, 1 << 31])))
                rng.shuffle(labels)
            mine = labels[at : at + batch.num_rows]
            at += batch.num_rows
            if len(mine) < batch.num_rows:
                raise RuntimeError("an input partition has more rows than were counted")
            keys = rng.integers(-(2**63), 2**63 - 1, len(mine))
            cols = [c for c, f in zip(batch.columns, batch.schema, strict=True) if f.name != part]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(mine), pa.array((mine // per).astype(np.int32)), pa.array(starts[mine]), pa.array(keys)], names=names)

    schema = T.StructType([*base.schema.fields, T.StructField(cell, T.IntegerType()), T.StructField(out_shard, T.IntegerType()), T.StructField(start, T.LongType()), T.StructField(key, T.LongType())])
    names = schema.names
    place = F.row_number().over(Window.partitionBy(cell).orderBy(key)) - 1
    return dealt.mapInArrow(deal, schema).withColumn(out_slot, F.col(start) + place).drop(cell, start, key)
