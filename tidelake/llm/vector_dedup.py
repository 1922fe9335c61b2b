"""Near-duplicate vectors by a robust-pruned flat graph, built on overlapping cluster shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import durable, stored
from tidelake.llm.components import components

CANDIDATES, DEGREE, ALPHA, BEAM, ENTRIES, PIVOTS = 48, 24, 1.2, 24, 8, 8


def centroids(sample: np.ndarray, rows: int, leaf_rows: int, tight: float, seed: int = 5) -> np.ndarray:
    """Unit centroids of a tree of k-means splits of a bounded sample, whose leaves stand for `leaf_rows` rows each.

    A leaf whose members are all within `tight` of their mean is left whole: near-duplicates belong together.
    """
    rng = np.random.default_rng(seed)
    todo, out = [sample], []
    while todo:
        x = todo.pop()
        mean = x.sum(0)
        mean = mean / (np.linalg.norm(mean) or 1.0)
        share = len(x) * rows / max(len(sample), 1)
        if share <= leaf_rows or len(x) < 4 or (x @ mean).min() >= tight:
            out.append(mean)
            continue
        k = int(min(16, max(2, math.ceil(share / leaf_rows)), len(x) // 2))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            c = np.stack([x[near == j].sum(0) if (near == j).any() else x[rng.integers(len(x))] for j in range(k)])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
        near = (x @ c.T).argmax(1)
        parts = [x[near == j] for j in range(k) if (near == j).any()]
        if len(parts) < 2:
            out.append(mean)
        else:
            todo += parts
    return np.array(out)


def prune(x: np.ndarray, own: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Robust pruning for all rows at once: of each row's pool (-1: none), at most DEGREE neighbours, nearest first.

    A candidate goes once a neighbour taken before it is ALPHA times nearer to it than the row is.
    """
    dist = np.where((pool < 0) | (pool == own[:, None]), np.inf, 2 - 2 * np.einsum("md,mkd->mk", x[own], x[pool]))
    order = np.argsort(dist, axis=1, kind="stable")
    pool, dist = np.take_along_axis(pool, order, 1), np.maximum(np.take_along_axis(dist, order, 1), 0)
    alive = np.isfinite(np.take_along_axis(np.where(dist > 1e9, np.inf, dist), np.arange(dist.shape[1])[None, :], 1))
    out, at = np.full((len(own), DEGREE), -1, np.int64), np.arange(len(own))
    for r in range(DEGREE):
        pick = alive.argmax(1)
        some = alive[at, pick]
        if not some.any():
            break
        taken = pool[at, pick]
        out[:, r] = np.where(some, taken, -1)
        between = 2 - 2 * np.einsum("md,mkd->mk", x[taken], x[pool])
        alive &= ~((ALPHA * ALPHA * between <= dist) & some[:, None])
        alive &= pool != taken[:, None]
    return out


def build(x: np.ndarray) -> np.ndarray:
    """Adjacency (rows x DEGREE, -1 for none) of a shard: nearest rows and shared pivots, pruned with reverse edges."""
    m = len(x)
    own, k = np.arange(m), min(CANDIDATES, m - 1)
    if k < 1:
        return np.full((m, DEGREE), -1, np.int64)
    near = np.empty((m, k), np.int64)
    for a in range(0, m, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        near[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    pivots = np.linspace(0, m - 1, min(PIVOTS, m)).astype(np.int64)
    out = np.concatenate([prune(x, own[a : a + 512], np.concatenate([near[a : a + 512], np.broadcast_to(pivots, (len(own[a : a + 512]), len(pivots)))], 1)) for a in range(0, m, 512)])
    src, dst = np.repeat(own, DEGREE), out.ravel()
    src, dst = src[dst >= 0], dst[dst >= 0]
    order = np.argsort(dst, kind="stable")
    src, dst = src[order], dst[order]
    rank = np.arange(len(dst)) - np.searchsorted(dst, dst)
    back = np.full((m, DEGREE), -1, np.int64)
    few = rank < DEGREE
    back[dst[few], rank[few]] = src[few]
    both = np.concatenate([out, back], 1)
    return np.concatenate([prune(x, own[a : a + 512], both[a : a + 512]) for a in range(0, m, 512)])


def search(x: np.ndarray, graph: np.ndarray, radius: float, slack: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with cosine >= radius, by range-expanding greedy search of all rows from the medoid.

    A beam goes down from the medoid and a few entries to each query; then every row found within the radius, less
    `slack`, is expanded until none is left. `graph` has neighbours by row, padded with -1.
    """
    m = len(x)
    mean = x.sum(0)
    entries = np.unique(np.append(np.linspace(0, m - 1, min(ENTRIES, m)).astype(np.int64), (x @ mean).argmax()))
    found_q, found_n = [], []
    for a in range(0, m, 512):
        own = np.arange(a, min(a + 512, m))
        rows = np.arange(len(own))
        beam = np.full((len(own), BEAM), -1, np.int64)
        beam[:, : len(entries)] = entries[:BEAM]
        score = np.where(beam >= 0, np.einsum("md,mkd->mk", x[own], x[beam]), -np.inf)
        open_ = beam >= 0
        for _ in range(4 * BEAM):
            best = np.where(open_, score, -np.inf).argmax(1)
            live = open_[rows, best]
            if not live.any():
                break
            open_[rows, best] = False
            step = graph[beam[rows, best]]
            step[~live] = -1
            known = (step[:, :, None] == beam[:, None, :]).any(2)
            step = np.where(known, -1, step)
            s = np.where(step >= 0, np.einsum("md,mkd->mk", x[own], x[step]), -np.inf)
            beam, score, open_ = np.concatenate([beam, step], 1), np.concatenate([score, s], 1), np.concatenate([open_, step >= 0], 1)
            top = np.argsort(-score, axis=1, kind="stable")[:, :BEAM]
            beam, score, open_ = np.take_along_axis(beam, top, 1), np.take_along_axis(score, top, 1), np.take_along_axis(open_, top, 1)
        seen = np.zeros((len(own), m), bool)
        q, n = np.nonzero((beam >= 0) & (score >= radius - slack))
        n = beam[q, n]
        while len(q):
            fresh_ = ~seen[q, n]
            q, n = q[fresh_], n[fresh_]
            seen[q, n] = True
            if len(q):
                code = np.unique(q * m + n)
                q, n = code // m, code % m
            good = np.empty(len(q), bool)
            for b in range(0, len(q), 200_000):
                s = np.einsum("pd,pd->p", x[own[q[b : b + 200_000]]], x[n[b : b + 200_000]])
                hit = s >= radius
                found_q.append(own[q[b : b + 200_000]][hit])
                found_n.append(n[b : b + 200_000][hit])
                good[b : b + 200_000] = s >= radius - slack
            q, n = q[good], n[good]
            next_q, next_n = [], []
            for b in range(0, len(q), 20_000):
                nn = graph[n[b : b + 20_000]]
                qq = np.broadcast_to(q[b : b + 20_000, None], nn.shape)
                keep = (nn >= 0) & ~seen[qq, nn]
                code = np.unique(qq[keep] * m + nn[keep])
                next_q.append(code // m)
                next_n.append(code % m)
            q, n = (np.concatenate(next_q), np.concatenate(next_n)) if next_q else (q[:0], n[:0])
    q, n = np.concatenate(found_q) if found_q else np.zeros(0, np.int64), np.concatenate(found_n) if found_n else np.zeros(0, np.int64)
    return q[q != n], n[q != n]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Unit rows; scaled by the greatest component first, so that no square overflows or vanishes."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True, initial=np.finfo(float).tiny)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def planted(x: np.ndarray, cosine: float, seed: int = 11) -> np.ndarray:
    """For each unit row a unit row whose cosine with it lies between `cosine` and 1, often near the limit."""
    rng = np.random.default_rng(seed)
    if x.shape[1] < 2:
        return x.copy()
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    c = cosine + (1 - cosine) * (0.02 + 0.96 * rng.random((len(x), 1)) ** 2)
    return c * x + np.sqrt(1 - c * c) * away


def least_of(n: int, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The least row of each row's component under links (q, r) that hold both ways."""
    root = np.arange(n)
    while len(q):
        low = root.copy()
        np.minimum.at(low, q, root[r])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return root


def complete(x: np.ndarray, root: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """All links, both ways, within each component of a task: what one search of two rows misses, the other's need not."""
    order = np.argsort(root, kind="stable")
    cuts = np.flatnonzero(np.append(True, root[order][1:] != root[order][:-1])) if len(root) else np.zeros(0, np.int64)
    qs, rs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, cuts[1:]):
        for a in range(0, len(rows) if len(rows) > 1 else 0, 512):
            i, j = np.nonzero(x[rows[a : a + 512]] @ x[rows].T >= radius)
            qs.append(rows[a + i])
            rs.append(rows[j])
    q, r = np.concatenate(qs), np.concatenate(rs)
    return q[q != r], r[q != r]


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, leaf_rows: int = 300, overlap: int = 3, task_rows: int = 2_000, sample_rows: int = 20_000, audit_rows: int = 200, least_recall: float = 0.95
) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept.

    Vectors of equal components are one class (its copies are linked, and counted, without pairs). Class vectors go
    to the shards of their `overlap` nearest centroids; a shard of over `task_rows` is dealt by hash into parts, and
    each pair of parts is a task, so that no dense group is one task. Tasks build robust-pruned graphs, a node's
    lists are united over its shards, and every task searches its rows in the part of the united graph that it holds;
    within the components so found no link is left out. Links are verified by their cosine in double precision and
    counted in the least task that both share. Links join by union-find.

    The centroids come from at most `sample_rows` classes (the one bounded sample); every row is indexed. Recall is
    audited against brute force over links between distinct vectors, for about `audit_rows` classes at random, the planted ones and as many
    that have links, each held against all; below `least_recall` the index is built again with one shard more for each
    row; if it is not reached with all shards, tasks compare all their rows. So that there is something to find in any table,
    each random class gets a planted neighbour just over the limit, which is indexed and searched like a row but
    counts as none and links nothing.

    Vectors that are null, empty, zero or of another length than most, or hold a null or non-finite component, link
    with nothing: no links, their own component, kept. Repeated keys count as rows of their own. Other columns play
    no part.
    """
    raw = vectors.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    marked = raw.withColumn("ok", fine)
    dims = marked.where("ok").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = dims[0] if dims else 0
    usable = marked.where(F.col("ok") & (F.size("v") == dim)).select("k", F.transform("v", lambda x: x + F.lit(0.0)).alias("v")).withColumn("id", F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))))))
    rows = durable(usable.select("k", "id"))
    classes = stored(usable.groupBy("id").agg(F.count("*").alias("n"), F.min("k").alias("least"), F.first("v").alias("v")))
    total = classes.count()
    out_type = vectors.schema[key].dataType.simpleString()
    alone = marked.where(~F.col("ok") | (F.size("v") != dim)).select(F.col("k"), F.lit(0).cast("bigint").alias("n_links"), F.col("k").alias("component_id"), F.lit(True).alias("kept"))
    if not total:
        return alone.withColumnRenamed("k", key)

    share = min(1.0, sample_rows / total)
    sample = classes.where((F.pmod(F.xxhash64("id", F.lit("s")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)).orderBy("id").limit(sample_rows).select("v").toArrow()["v"].combine_chunks()
    heads = centroids(_matrix(sample, dim), total, leaf_rows, math.cos(math.acos(cosine) / 2))
    step = max(1, total // audit_rows)
    anyone = classes.where(F.pmod(F.xxhash64("id", F.lit("a")), F.lit(step)) == 0).select("id", "v").limit(4 * audit_rows).toArrow()
    plants = planted(_matrix(anyone["v"].combine_chunks(), dim), cosine) if len(anyone) else np.zeros((0, dim))
    none = [(hashlib.md5(b"planted" + i).digest(), 0, None, v.tolist()) for i, v in zip(anyone["id"].to_pylist(), plants, strict=True)]
    indexed = stored(classes.union(vectors.sparkSession.createDataFrame(none, classes.schema)))

    def recall(sums: DataFrame) -> float:
        """Share of the true links to other vectors of the table that were found, for the random classes, their planted
        neighbours and about as many classes with links, held against all classes."""
        some = sums.where("others > 0").join(classes.select("id"), "id", "left_semi")
        share = max(1, some.count() // audit_rows)
        chosen = some.where(F.pmod(F.xxhash64("id", F.lit("b")), F.lit(share)) == 0).select("id").limit(4 * audit_rows)
        queries = classes.join(F.broadcast(chosen), "id").select("id", "v").toArrow()
        x = {i: v for i, v in zip(anyone["id"].to_pylist(), _matrix(anyone["v"].combine_chunks(), dim), strict=True)} if len(anyone) else {}
        if len(queries):
            x |= dict(zip(queries["id"].to_pylist(), _matrix(queries["v"].combine_chunks(), dim), strict=True))
        own = len(x)
        x |= {r[0]: v for r, v in zip(none, plants, strict=True)}
        q_ids, q_x = list(x), np.array(list(x.values())).reshape(len(x), dim)
        self_ = np.arange(len(x)) < own  # a class of the table finds itself, too

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(q_ids), np.int64)
            for b in batches:
                for a in range(0, b.num_rows, 4096):
                    out += ((q_x @ _matrix(b.column(0).slice(a, 4096), dim).T) >= cosine).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids, pa.binary()), pa.array(self_), pa.array(out)], names=["id", "self", "n"])

        truth = classes.select("v").mapInArrow(brute, "id binary, self boolean, n bigint").groupBy("id").agg((F.sum("n") - F.max(F.col("self").cast("int"))).alias("all"))
        found_, true_ = truth.join(sums, "id", "left").agg(F.sum(F.least(F.coalesce("others", F.lit(0)), "all")), F.sum("all")).first()
        return (found_ or 0) / true_ if true_ else 0.0

    exact = False
    while True:
        take = min(overlap, len(heads))

        def place(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                parts = []
                for a in range(0, len(column), 4096):
                    s = _matrix(column.slice(a, 4096), dim) @ heads.T
                    parts.append(np.argpartition(-s, take - 1, axis=1)[:, :take] if take < len(heads) else np.tile(np.arange(len(heads)), (len(s), 1)))
                flat = np.concatenate(parts) if parts else np.zeros((0, take), np.int64)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * take), pa.array(flat.ravel().astype(np.int64)))

        placed = durable(indexed.withColumn("shards", F.arrow_udf(place, "array<bigint>")("v")).select("id", "n", "shards"))
        sizes = placed.select(F.explode("shards").alias("s")).groupBy("s").count().where(F.col("count") > task_rows)
        large = {r[0]: math.ceil(2 * r[1] / task_rows) for r in sizes.collect()}  # at most a number for each centroid
        most = max(large.values(), default=1) + 1
        parts_of = F.create_map(*(F.lit(x) for kv in large.items() for x in kv)) if large else None

        def tasks(s):
            code = s * F.lit(most * most)
            if parts_of is None:
                return F.array(code)
            p = F.coalesce(parts_of[s], F.lit(1)).cast("int")
            mine = F.pmod(F.xxhash64("id"), p).cast("bigint")
            return F.transform(F.sequence(F.lit(0), p - 1), lambda j: code + F.least(mine, j.cast("bigint")) * most + F.greatest(mine, j.cast("bigint")))

        dealt = placed.withColumn("tasks", F.array_sort(F.flatten(F.transform("shards", tasks)))).drop("shards")
        members = stored(dealt.join(indexed.select("id", "v"), "id"))
        by_task = members.select(F.explode("tasks").alias("task"), "id", "v")

        def graph(t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by("id")
            ids = t["id"].combine_chunks() if isinstance(t["id"], pa.ChunkedArray) else t["id"]
            near = build(_matrix(t["v"].combine_chunks(), dim))
            flat = near.ravel()
            ends = np.concatenate([[0], np.cumsum((near >= 0).sum(1))]).astype(np.int32)
            return pa.table({"id": ids, "near": pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(flat[flat >= 0])))})

        lists = by_task.groupBy("task").applyInArrow(graph, "id binary, near array<binary>")
        united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list for each shard of the row

        def find(t: pa.Table) -> pa.Table:
            t = t.combine_chunks().sort_by("id")
            ids, x = t["id"].to_pylist(), _matrix(t["v"].combine_chunks(), dim)
            place_of = {i: p for p, i in enumerate(ids)}
            near = [[place_of[y] for y in z if y in place_of] for z in t["near"].to_pylist()]
            wide = np.full((len(ids), max(map(len, near), default=0) or 1), -1, np.int64)
            for i, z in enumerate(near):
                wide[i, : len(z)] = z
            q, r = search(x, wide, cosine)
            root = np.zeros(len(ids), np.int64) if exact else least_of(len(ids), np.concatenate([q, r]), np.concatenate([r, q]))
            q, r = complete(x, root, cosine)
            real = np.array(t["n"].to_pylist(), np.int64) > 0
            both = real[q] & real[r]
            root = least_of(len(ids), q[both], r[both])  # planted rows join nothing
            own = t["tasks"].to_pylist()
            task = t["task"][0].as_py()
            sets = [set(z) for z in own]
            first = np.array([len(z) == 1 for z in own], bool)
            mine = np.array([first[i] or first[j] or task == min(sets[i] & sets[j]) for i, j in zip(q.tolist(), r.tolist(), strict=True)], bool) if len(q) else np.zeros(0, bool)
            weight = np.array(t["n"].to_pylist(), np.int64)
            links = np.bincount(q[mine], weight[r[mine]], len(ids)).astype(np.int64)
            distinct = np.bincount(q[mine], real[r[mine]], len(ids)).astype(np.int64)
            return pa.table({"id": t["id"], "links": pa.array(links), "others": pa.array(distinct), "root": t["id"].combine_chunks().take(pa.array(root)) if isinstance(t["id"], pa.ChunkedArray) else t["id"].take(pa.array(root))})

        searched = members.join(united, "id").select(F.explode("tasks").alias("task"), "id", "n", "v", "near", "tasks")
        found = stored(searched.groupBy("task").applyInArrow(find, "id binary, links bigint, others bigint, root binary"))
        sums = durable(found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("others").alias("others")))
        linked = durable(sums.join(classes.select("id", "n", "least"), "id").withColumn("n_links", F.col("links") + F.col("n") - 1))
        if exact or recall(sums) >= least_recall:
            break
        exact, overlap = take == len(heads), overlap + 1

    roots = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = durable(linked.join(roots, "id", "left").select("id", "n_links", "least", F.coalesce("root", "id").alias("root")))
    named = durable(grouped.join(grouped.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "n_links", "component_id"))
    whole = rows.join(named, "id").select("k", "n_links", "component_id", (F.col("k") == F.col("component_id")).alias("kept"))
    return whole.union(alone).select(F.col("k").cast(out_type).alias(key), "n_links", "component_id", "kept")
