"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm import components
from tidelake.llm.common import fresh, passing, stored
from tidelake.llm.components import joined, open_blocks, shared

WORDS = 5
BANDS, ROWS = 10, 3
#: The texts of a block that is compared in one task weigh about so much (a shingle weighs up to 1 + ln N), or are one text.
BLOCK_WEIGHT = 4_000_000
#: Shared counters that bound document frequencies from above, in pieces; and parts in which tasks add theirs up.
COUNTERS, PIECE, PARTS = 1 << 20, 1 << 12, 1_000
#: Bits of the filter for shingles of candidates, and its pieces; a full filter lets more shingles move and changes no count.
FILTER_BITS, FILTER_PIECES = 1 << 27, 256
#: Shingles that are sampled at once, of whole texts: arrays of this length stay in a core's cache.
AT_ONCE = 1 << 15
#: Candidates get their frequencies in parts of about so many bytes of text.
PART_BYTES = 500_000
SLICE_BYTES = 8_000_000
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of all runs of WORDS words of the texts, in order; words are lower-case runs of letters and digits."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\pL\pN\s]+", " ")
    parts = pc.ascii_split_whitespace(clean)
    flat = parts.flatten()
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_pylist()
    known = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
    word = known[coded.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    real = np.array([bool(x) for x in names], bool)[coded.indices.to_numpy()] if len(names) else np.zeros(0, bool)
    word, doc = word[real], doc[real]
    n = len(word) - WORDS + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(WORDS):
        h += word[i : i + n] * ODD[i]
    h ^= h >> np.uint64(29)
    h *= ODD[0]
    h ^= h >> np.uint64(32)
    same = doc[:n] == doc[WORDS - 1 :]
    return doc[:n][same], h[same]


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) of rows in order of documents, sorted, with how often each occurs."""
    h = h.copy()
    for part in np.split(h, np.flatnonzero(doc[1:] != doc[:-1]) + 1):  # views, each sorted in place
        part.sort()
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a column of texts of about SLICE_BYTES, a row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    while at < len(sizes):
        to = min(len(sizes), at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES))))
        yield column.slice(at, to - at)
        at = to


def tf_idf(documents: int, df: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Occurrences times 1 + ln(N / df)."""
    return times * (1 + np.log(max(documents, 1) / df))


class Bounds:
    """Weights for sampling: TF-IDF by the shared counters, which bound every document frequency from above."""

    def __init__(self, documents: int, counters: np.ndarray) -> None:
        self.documents = documents
        self.idf = tf_idf(documents, np.clip(counters, 1, max(documents, 1)), 1)

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.idf[(h >> np.uint64(44)).astype(np.int64)] * times


def _sum_pieces(t: pa.Table) -> pa.Table:
    total = np.zeros(PIECE, np.int64)
    for x in t["counts"].to_pylist():
        total += np.frombuffer(x, np.int64)
    return pa.table({"piece": t["piece"].slice(0, 1), "part": pa.array([0], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary()), "rows": pa.array([sum(t["rows"].to_pylist())], pa.int64())})


def fit(docs: DataFrame, text: str) -> Bounds:
    """Counts of all documents' shingles in COUNTERS shared counters. Counters are added up in two steps, so that no
    task sees those of all; their number is fixed, so they fit the driver at any size of corpus.
    """
    texts = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    spec = "piece bigint, part bigint, counts binary, rows bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, part = np.zeros(COUNTERS, np.int64), 0, TaskContext.get().partitionId() % PARTS
        for batch in batches:
            rows += batch.num_rows
            for piece in slices(batch.column(0)):
                doc, h = shingles(piece)
                _, h, _ = counted(doc, h)
                total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=COUNTERS)
        if rows:
            n = COUNTERS // PIECE
            cut = [total[i * PIECE : (i + 1) * PIECE].tobytes() for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([part] * n, pa.int64()), pa.array(cut, pa.binary()), pa.array([rows] + [0] * (n - 1), pa.int64())], names=["piece", "part", "counts", "rows"])

    parts = texts.mapInArrow(count, spec).groupBy("piece", "part").applyInArrow(_sum_pieces, spec)
    sums = stored(parts.groupBy("piece").applyInArrow(_sum_pieces, spec))
    documents = sums.agg(F.sum("rows")).first()[0] or 0
    counters = np.zeros(COUNTERS, np.int64)
    for r in sums.select("piece", "counts").toLocalIterator():  # COUNTERS numbers in all
        counters[r["piece"] * PIECE : (r["piece"] + 1) * PIECE] = np.frombuffer(r["counts"], np.int64)
    return Bounds(documents, counters)


def _packed(df: np.ndarray) -> bytes:
    return zlib.compress(df.astype(np.int64).tobytes(), 1)


def _unpacked(packed: pa.Array) -> np.ndarray:
    parts = [np.frombuffer(zlib.decompress(x), np.int64) for x in packed.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def frequencies(docs: DataFrame, text: str, texts: DataFrame, documents: int, filter_bits: int = FILTER_BITS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Of each row (id, t) of the stored `texts`: the exact document frequencies in `docs` of its distinct shingles.

    Returns (id, t, df, weight): `df` packed in the order of `counted`, `weight` the sum of the text's TF-IDF weights.
    The shingles asked for set the bits of a filter of fixed size; every document's shingles that pass it are counted,
    combined within tasks before they move. Counts of two or more go back to the parts that asked (a shingle of one
    document has the count 1), so a shingle that all ask for is one row a part, and a part is texts of about
    `part_bytes`.
    """
    parts = max(1, math.ceil((texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0) / part_bytes))
    piece_bits = filter_bits // FILTER_PIECES
    dealt = texts.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(parts)))

    def place(h: np.ndarray) -> np.ndarray:
        """The bit of the filter for each hash; the low bits, as the counters take the high ones."""
        return (h & np.uint64(filter_bits - 1)).astype(np.int64)

    def bits(t: pa.Table) -> pa.Table:
        """One piece of the filter from the hashes that fall into it."""
        on = np.zeros(piece_bits, bool)
        on[place(t["h"].to_numpy().view(np.uint64)) % piece_bits] = True
        return pa.table({"piece": t["piece"].slice(0, 1), "bits": pa.array([np.packbits(on).tobytes()], pa.binary())})

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.column(0).to_numpy()
            at = 0
            for piece in slices(batch.column(1)):
                doc, h, _ = counted(*shingles(piece))
                order = np.argsort(where[at + doc], kind="stable")
                _, h, _ = part = counted(where[at + doc][order], h[order])
                at += len(piece)
                yield pa.RecordBatch.from_arrays([pa.array(part[0]), pa.array(h.view(np.int64)), pa.array(place(h) // piece_bits)], names=["p", "h", "piece"])

    asked = stored(dealt.select("p", "t").mapInArrow(ask, "p bigint, h bigint, piece bigint"))
    wanted = np.zeros(filter_bits // 8, np.uint8)
    size = piece_bits // 8
    for r in stored(asked.select("piece", "h").groupBy("piece").applyInArrow(bits, "piece bigint, bits binary")).toLocalIterator():  # `filter_bits` in all
        wanted[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    shared_filter = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = shared_filter.value
        for batch in batches:
            for piece in slices(batch.column(0)):
                doc, h = shingles(piece)
                at = place(h)
                keep = (on[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
                values, times = np.unique(counted(doc[keep], h[keep])[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(times)], names=["h", "n"])

    counts = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull()).mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    told = asked.select("p", "h").join(counts.hint("shuffle_hash"), "h").select("p", "h", "n")

    def weigh(mine: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["h"].to_numpy().view(np.uint64))
        hashes, n = known["h"].to_numpy().view(np.uint64)[order], known["n"].to_numpy()[order]
        mine = mine.combine_chunks()
        dfs, sums = [], []
        for piece in slices(mine["t"].combine_chunks()):
            doc, h, times = counted(*shingles(piece))
            df = np.ones(len(h), np.int64)
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                df = np.where(hashes[at] == h, n[at], df)
            ends = np.searchsorted(doc, np.arange(len(piece) + 1))
            dfs += [_packed(df[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            sums += np.bincount(doc, tf_idf(documents, df, times), len(piece)).tolist()
        return pa.table({"id": mine["id"], "t": mine["t"], "df": pa.array(dfs, pa.binary()), "weight": pa.array(sums, pa.float64())})

    both = dealt.select("p", "id", "t").groupBy("p").cogroup(told.groupBy("p"))
    return stored(both.applyInArrow(weigh, "id binary, t string, df binary, weight double"))


def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tables of Gamma(2, 1), log Gamma(2, 1) and uniform draws, and an odd multiplier for each sample to look them up."""
    rng = np.random.Generator(np.random.Philox(7))
    r, c, b = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
    return r, np.log(c), b, rng.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(texts: pa.Array, weights: Bounds) -> list[list[int]]:
    """BANDS keys for each text, none for texts without shingles.

    Improved consistent weighted sampling: of each shingle, for each sample, draws fixed by its hash turn the weight
    into a quantised step t and a value ln a; the shingle of least ln a is taken with its t. Two texts take the same
    with the probability of their weighted Jaccard similarity. ROWS samples in a row make a key.
    """
    r_table, c_table, b_table, odd = _draws()
    doc, h, times = counted(*shingles(texts))
    out: list[list[int]] = [[] for _ in range(len(texts))]
    if not len(h):
        return out
    log_w = np.log(weights.of(h, times))
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    ends = np.append(starts[1:], len(doc))
    keys = np.zeros((len(starts), BANDS), np.uint64)
    low, cuts = np.uint64(0xFFFF), np.flatnonzero(np.diff(starts // AT_ONCE, prepend=-1))
    for one, two in zip(cuts, np.append(cuts[1:], len(starts)), strict=True):
        part = slice(starts[one], ends[two - 1])
        own, log_own, at_start, lens = h[part], log_w[part], starts[one:two] - starts[one], ends[one:two] - starts[one:two]
        for k in range(BANDS * ROWS):
            m = own * odd[k]
            r = r_table[(m >> np.uint64(48)).astype(np.int64)]
            b = b_table[((m >> np.uint64(16)) & low).astype(np.int64)]
            t = np.floor(log_own / r + b)
            log_a = c_table[((m >> np.uint64(32)) & low).astype(np.int64)] - r * (t - b + 1)
            at = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, at_start), lens))
            best = at[np.searchsorted(at, at_start)]  # of ties, the first
            band = keys[one:two, k // ROWS]
            mixed = (own[best] + t[best].astype(np.int64).view(np.uint64) * ODD[1]) * ODD[2]
            band[:] = (band ^ (mixed ^ (mixed >> np.uint64(31)))) * ODD[3] + np.uint64(k + 1)
    for i, row in zip(doc[starts].tolist(), keys.view(np.int64).tolist(), strict=True):
        out[i] = row
    return out


def weighted_jaccard(left: pa.Array, right: pa.Array, left_df: pa.Array, right_df: pa.Array, documents: int) -> np.ndarray:
    """Weighted Jaccard similarity of each pair of texts: sum of least over sum of greatest weights; 0 without shingles."""
    a, b = counted(*shingles(left)), counted(*shingles(right))
    doc, h = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    w = tf_idf(documents, np.concatenate([_unpacked(left_df), _unpacked(right_df)]), np.concatenate([a[2], b[2]]))
    order = np.lexsort((h, doc))
    doc, h, w = doc[order], h[order], w[order]
    twin = np.flatnonzero((doc[1:] == doc[:-1]) & (h[1:] == h[:-1]))
    least = np.bincount(doc[twin], np.minimum(w[twin], w[twin + 1]), len(left))
    total = np.bincount(doc, w, len(left)) - least
    return np.divide(least, total, out=np.zeros(len(left)), where=total > 0)


def block_links(texts: pa.Array, df: pa.Array, roots: np.ndarray, side: np.ndarray, documents: int, similarity: float) -> list[tuple[int, int]]:
    """Links that join the components of `roots` among the texts of two blocks (side 0 and 1), or of one (all of side 0).

    Each text in turn is held against all those that it is to meet and that no link joins to it so far; a link that
    would join nothing is left out. Memory is that of the blocks' shingles.
    """
    doc, h, times = counted(*shingles(texts))
    code = np.unique(h, return_inverse=True)[1]
    w = tf_idf(documents, _unpacked(df), times)
    total = np.bincount(doc, w, len(texts))
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    group = np.unique(roots, return_inverse=True)[1]
    own = np.zeros(int(code.max()) + 1 if len(code) else 0)
    two = bool(side.any())
    few = 1 if two and side.sum() * 2 < len(side) else 0
    out = []
    for i in np.flatnonzero(side == few):
        open_ = (side != few) if two else np.arange(len(side)) > i
        open_ &= (group != group[i]) & (np.minimum(total, total[i]) >= similarity * np.maximum(total, total[i]) - 1e-9) & (total > 0)
        if not open_.any():
            continue
        mine = slice(starts[i], starts[i + 1])
        own[code[mine]] = w[mine]
        least = np.bincount(doc, np.minimum(own[code], w), len(texts))
        own[code[mine]] = 0
        for j in np.flatnonzero(open_ & (least >= similarity * (total + total[i] - least) - 1e-9)):
            if group[i] != group[j]:
                out.append((int(i), int(j)))
                group[group == group[j]] = group[i]
    return out


def _grouped(docs: DataFrame, similarity: float) -> DataFrame:
    """Rows (k, id, class_id, kept) of documents (k, t), `id` the MD5 of the text (see `clusters`)."""
    whole = docs.where(F.col("t").isNotNull()).withColumn("id", F.unhex(F.md5("t")))
    weights = fit(docs, "t")

    def sign(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([keys for part in slices(column) for keys in band_keys(part, weights)], pa.list_(pa.int64()))

    rows = stored(whole.select("k", "id", F.arrow_udf(sign, "array<bigint>")("t").alias("bands")))
    classes = stored(rows.groupBy("id").agg(F.min("k").alias("least"), F.first("bands").alias("bands")))
    members = shared(classes.select(F.explode("bands").alias("key"), "id").distinct())
    texts = stored(whole.join(members.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.first("t").alias("t")))
    weighed = frequencies(docs, "t", texts, weights.documents)
    step = 1.0001 * max(math.log(1 / similarity), 0.01)  # weights of alike texts are at most one grade apart
    hints = weighed.where("weight > 0").select("id", F.col("weight").alias("hint"), F.floor(F.log("weight") / step).cast("int").alias("grade"))
    documents = weights.documents

    def similar(pairs: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for left, right, left_df, right_df in pairs:
            step = max(1, int(len(left) * SLICE_BYTES / (left.nbytes + right.nbytes + 1)))
            parts = [weighted_jaccard(*(x.slice(i, step) for x in (left, right, left_df, right_df)), documents) for i in range(0, len(left), step)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = t["id"].combine_chunks()
        roots = pc.dictionary_encode(t["root"].combine_chunks()).indices.to_numpy()
        links = block_links(t["t"].combine_chunks(), t["df"].combine_chunks(), roots, t["side"].to_numpy(), documents, similarity)
        a, b = (ids.take(pa.array([x[side] for x in links], pa.int64())) for side in range(2))
        return pa.table({"a": a, "b": b})

    def meet(members: DataFrame) -> DataFrame:
        """Links between the members of large buckets, block by block; the heavier the texts of a grade, the fewer a block."""
        heaviest = F.exp((F.col("grade") + 1) * step)
        met = open_blocks(members, F.greatest(F.lit(1.0), F.least(F.lit(float(components.BLOCK)), F.lit(BLOCK_WEIGHT) / heaviest)))
        return met.join(weighed.select("id", "t", "df"), "id").groupBy("key", "block", "block_b").applyInArrow(compare, "a binary, b binary").distinct()

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (weighed.select(F.col("id").alias(x), F.col("t").alias(f"t{x}"), F.col("df").alias(f"df{x}")) for x in "ab")
        both = pairs.join(left, "a").join(right, "b")
        return both.withColumn("s", F.arrow_udf(similar, "double")("ta", "tb", "dfa", "dfb")).where(F.col("s") >= similarity - 1e-9).select("a", "b")

    roots = joined(members, verify, hints, meet=meet)
    grouped = stored(classes.join(roots, "id", "left").select("id", "least", F.coalesce("root", "id").alias("root")))
    named = stored(grouped.join(grouped.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("id", "class_id"))
    found = rows.join(named, "id").select("k", "id", "class_id", F.coalesce(F.col("k") == F.col("class_id"), F.lit(True)).alias("kept"))
    alone = docs.where(F.col("t").isNull()).select("k", F.lit(None).cast("binary").alias("id"), F.col("k").alias("class_id"), F.lit(True).alias("kept"))
    return found.union(alone)


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8) -> DataFrame:
    """One row per document: its key, text hash, `class_id` (the least key of its group) and `kept` (it has that key).

    Equal texts are one class. Classes whose weighted Jaccard similarity over TF-IDF five-word shingles is
    `similarity` or more are linked, and groups are the connected components. The weight of a shingle is how often the
    text has it times 1 + ln(N / df), N and df counted over all documents that are not null. Candidates share one of
    BANDS keys, sampled with df bounded from above (see `Bounds`); every link is verified on the whole texts with the
    exact df (see `frequencies`). Copies are never expanded into pairs; large buckets are compared by stars
    first, then block by block (see `components.joined` and `block_links`). A text without five words equals only its copies. A null text is a group of
    its own and is kept. Rows of one key and text are one document, answered alike; ties go to the least key.
    """
    with passing(docs.sparkSession):
        found = stored(_grouped(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), similarity), last=True)
    return found.select(F.col("k").alias(key), F.col("id").alias("text_md5"), "class_id", "kept")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """The documents of which each group keeps one; all columns stay as they are (see `clusters`)."""
    (name, digest) = fresh(docs, "_gone", "_md5")
    gone = stored(clusters(docs, key, text, similarity).where("NOT kept").select(F.col(key).alias(name), F.col("text_md5").alias(digest)).distinct())
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return docs.join(side, docs[key].eqNullSafe(side[name]) & (F.unhex(F.md5(docs[text])) == side[digest]), "left_anti")
