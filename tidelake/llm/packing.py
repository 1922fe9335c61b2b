"""Best-fit packing of token sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidelake.llm.common import durable, fresh, salt_count

SLICE_BYTES = 8_000_000
CACHED_WORDS = 500_000
#: Fixed by the tokenizer file: its pre-token pattern, over lower-cased text.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Runs of other characters than white space and the lower-case letters that PLAIN leaves.
BETWEEN = r"([^a-z\s\x{aa}\x{b5}\x{ba}\x{df}-\x{f6}\x{f8}-\x{ff}]+)"
#: Texts of these characters alone lower-case and normalise one by one, and have plain white space only.
PLAIN = r"^[\t\n\r -~\x{a1}-\x{ac}\x{ae}-\x{ff}]*$"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + hidden.index(b)) for b in range(256)]


class WordEncoder:
    """Token ids of whole texts from the ids of their pre-tokens, which come from a cache of bounded size.

    Byte-pair merges never cross a pre-token, so a text's ids are those of its pre-tokens in order. Columns of text
    are lower-cased and cut at white space and around letters by Arrow; only a part not met before is cut into
    pre-tokens and reaches the tokenizer's model. Texts outside `PLAIN`, with an apostrophe (a pre-token may begin
    with it and go on with letters) or the mark of a special token go through the whole tokenizer instead.
    """

    def __init__(self, path: str, end_id: int) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end_id = end_id
        self.letters = byte_letters()
        self.clear()

    def clear(self) -> None:
        self.codes: dict[str, int] = {"": 1}
        self.n = 2  # code 0 is the end of a document, 1 is nothing
        self.starts, self.lens = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.pool, self.used = np.zeros(1 << 18, np.uint32), 1
        self.pool[0], self.lens[0] = self.end_id, 1

    def add(self, ids: list[list[int]]) -> int:
        """Keeps sequences of ids; the code of the first, others follow."""
        first, total = self.n, sum(map(len, ids))
        while self.n + len(ids) > len(self.starts):
            self.starts, self.lens = np.concatenate([self.starts, self.starts]), np.concatenate([self.lens, self.lens])
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, self.pool])
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        self.pool[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        self.starts[first : first + len(ids)] = self.used + np.cumsum(lens) - lens
        self.lens[first : first + len(ids)] = lens
        self.n, self.used = first + len(ids), self.used + total
        return first

    def word_ids(self, part: str) -> list[int]:
        out = []
        for word in (part,) if part.isalpha() else PRE_TOKEN.findall(part):
            if not word.isascii():
                word = "".join(map(self.letters.__getitem__, word.encode()))
            out += [t.id for t in self.model.tokenize(word)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each followed by the end id, and the place where each text's ids start, with the end."""
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring_regex(texts, r"'|<\|")))
        marked = pc.replace_substring_regex(pc.utf8_lower(pc.if_else(plain, texts, "")), BETWEEN, r" \1 ")
        parts = pc.ascii_split_whitespace(marked)
        coded = parts.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.codes) + len(names) > CACHED_WORDS:
            kept = {x: self.pool[self.starts[c] : self.starts[c] + self.lens[c]].tolist() for x in names if (c := self.codes.get(x, 0)) > 1}
            self.clear()
            self.codes.update(zip(kept, range(self.add(list(kept.values())), self.n), strict=True))
        new = [x for x in names if x not in self.codes]
        self.codes.update(zip(new, range(self.add([self.word_ids(x) for x in new]), self.n), strict=True))
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        whole = self.add([self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids for i in odd]) + np.arange(len(odd))
        known = np.fromiter(map(self.codes.__getitem__, names), np.int64, len(names))
        counts = pc.list_value_length(parts).to_numpy().astype(np.int64)
        given = known[coded.indices.to_numpy()]
        if len(odd):  # a text that was cut out above is one sequence of its own
            at = np.cumsum(counts) - counts
            keep = np.ones(len(given), bool)
            for i in odd:
                keep[at[i] : at[i] + counts[i]] = False
            given, counts = given[keep], np.where(plain.to_numpy(zero_copy_only=False), counts, 0)
            given = np.insert(given, (np.cumsum(counts) - counts)[odd], whole)
            counts[odd] = 1
        ends = np.cumsum(counts)
        codes = np.zeros(len(given) + len(counts), np.int64)
        codes[np.arange(len(given)) + np.repeat(np.arange(len(counts)), counts)] = given
        lens = self.lens[codes]
        after = np.cumsum(lens)
        ids = self.pool[np.repeat(self.starts[codes] - (after - lens), lens) + np.arange(int(after[-1]) if len(after) else 0)]
        if len(odd):
            self.n, self.used = self.n - len(odd), int(self.starts[whole[0]])
        return ids, np.concatenate([[0], after[ends + np.arange(len(counts))]])


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges with about SLICE_BYTES of text each, a row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy().astype(np.int64)
    at = 0
    while at < len(sizes):
        to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), SLICE_BYTES)))
        yield at, min(to, len(sizes))
        at = to


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Token pieces of every document: its columns but `text`, with `piece`, `start`, `length` and `ids`.

    A document is the ids of its whole text and then `end_id`; a null or empty text is `end_id` alone. Documents of
    more than `capacity` ids are cut into pieces of `capacity`, the last may be shorter; others are one piece.
    `ids` is binary, little-endian unsigned 32-bit. Rows do not move, and memory is bounded by a few MB of text and
    the word cache. A new column gets a trailing `_` where its name is taken.
    """
    rest = docs.drop(text)
    new = fresh(rest, "piece", "start", "length", "ids")
    schema = T.StructType([*rest.schema.fields, T.StructField(new[0], T.IntegerType()), T.StructField(new[1], T.LongType()), T.StructField(new[2], T.LongType()), T.StructField(new[3], T.BinaryType())])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path, end_id)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for a, b in _slices(batch.column(place)):
                part = batch.slice(a, b - a)
                ids, ends = encoder.encode(part.column(place))
                data = memoryview(ids.astype("<u4").tobytes())
                total = np.diff(ends)
                n = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = number * capacity
                length = np.minimum(capacity, total[row] - start)
                first = (ends[row] + start) * 4
                blobs = [bytes(data[x : x + y]) for x, y in zip(first.tolist(), (length * 4).tolist(), strict=True)]
                others = [c.take(pa.array(row)) for i, c in enumerate(part.columns) if i != place]
                yield pa.RecordBatch.from_arrays([*others, pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(blobs, pa.binary())], names=names)

    return docs.select(*rest.columns, text).mapInArrow(run, schema)


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """Of the available lengths, the largest one and with it the combination that leaves the least slack.

    Subset sums are bits of an integer: shifting by a length adds it to every sum. A length with several pieces is
    added in powers of two. The bits before each length lead back to the combination. Stops at a full bin.
    """
    largest = max(counts)
    room = capacity - largest
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left = min(counts[length] - (length == largest), room // length)
        if left <= 0:
            continue
        steps.append((length, left, reach))
        many = 1
        while left:
            take = min(many, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            many *= 2
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, {largest: 1}
    for length, left, before in reversed(steps):
        k = next(k for k in range(left + 1) if at >= k * length and before >> (at - k * length) & 1)
        if k:
            used[length] = used.get(length, 0) + k
            at -= k * length
    return sorted(used.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Minimum bin slack over a histogram of lengths: rows of (length, first rank, first sequence, uses, offset).

    A combination is taken as often as its lengths allow, so each one uses some length up; the number of rows
    depends on the capacity and not on the number of pieces.
    """
    left, used, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        combination = fullest(left, capacity)
        times = min(left[length] // n for length, n in combination)
        offset = 0
        for length, n in combination:
            rows.append((length, used[length], sequence, n, offset))
            offset += n * length
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def assign(rows: DataFrame, capacity: int = 4096, length: str = "length") -> DataFrame:
    """Every row with its `sequence_id` and its `offset` there, in as few sequences as minimum bin slack finds.

    Only the histogram of lengths, `capacity` numbers at most, reaches the driver. A row's place follows from its
    rank among rows of its length: ranks are counted in salted groups, so that a length that most rows share is
    many tasks, and salts grow with the rows. The input is checkpointed, as ranks need fixed rows. Lengths must be
    1 to `capacity`, others raise an error. No rows give no sequences; repeated rows are packed each on its own.
    """
    base = durable(rows)
    rid, salt, before, place = fresh(base, "_rid", "_salt", "_before", "_place")
    new = fresh(base, "sequence_id", "offset")
    sized = base.groupBy(F.col(length).cast("long").alias("l")).count().collect()
    histogram = {r[0]: r[1] for r in sized}
    if any(x is None or not 1 <= x <= capacity for x in histogram):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    total = sum(histogram.values())
    rules = plan(histogram, capacity)
    span = max(total, 1) + 1
    starts = rules[:, 0] * span + rules[:, 1]

    keyed = base.withColumn(rid, F.monotonically_increasing_id()).withColumn(salt, F.pmod(F.xxhash64(rid), F.lit(salt_count(total))).cast("int"))
    counts = keyed.groupBy(F.col(length).alias("_l"), F.col(salt).alias("_s")).count()
    ahead = counts.withColumn(before, F.sum("count").over(Window.partitionBy("_l").orderBy("_s")) - F.col("count")).drop("count")
    ranked = keyed.withColumn(place, F.row_number().over(Window.partitionBy(length, salt).orderBy(rid)).cast("long") - 1)
    ranked = ranked.join(ahead, (F.col(length) == F.col("_l")) & (F.col(salt) == F.col("_s"))).withColumn(place, F.col(place) + F.col(before)).drop("_l", "_s", before)

    def locate(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lengths, ranks in columns:
            size, rank = lengths.to_numpy().astype(np.int64), ranks.to_numpy()
            found = rules[np.searchsorted(starts, size * span + rank, side="right") - 1]
            local = rank - found[:, 1]
            yield pa.StructArray.from_arrays([pa.array(found[:, 2] + local // found[:, 3]), pa.array(found[:, 4] + local % found[:, 3] * size)], names=["s", "o"])

    if not histogram:
        return base.withColumn(new[0], F.lit(None).cast("long")).withColumn(new[1], F.lit(None).cast("long"))
    where = F.arrow_udf(locate, "struct<s:bigint,o:bigint>")(F.col(length), F.col(place))
    return ranked.withColumn(place, where).withColumn(new[0], F.col(place)["s"]).withColumn(new[1], F.col(place)["o"]).drop(place, rid, salt)


def pack(docs: DataFrame, tokenizer_path: str, text: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents cut into token pieces and packed; see `pieces` and `assign`."""
    length = fresh(docs.drop(text), "piece", "start", "length")[2]
    return assign(pieces(docs, tokenizer_path, text, capacity, end_id), capacity, length)
