"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelake.llm.common import fresh

UNKNOWN = "und"
#: Bits of evidence that one more compressed byte counts for in the score; well under 8, as bytes of one text depend on each other.
BITS = 1.0
#: Steps from 0 to 1 in which margins are counted.
STEPS = 1 << 16


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dict_bytes: int = 65_536, word_chars: int = 16) -> dict[str, bytes]:
    """A raw-content dictionary for each language: the words that all its labelled rows use most, the most frequent last.

    Words are counted exactly over every row, in tasks and by hash; a longer word counts as parts of `word_chars`
    characters. Equal counts go by the word. Only the words that may fit `dict_bytes` reach the driver: the tasks
    keep the first half as many words as bytes of each language, and pass on no more. Null labels and texts without a letter
    teach nothing. No labelled rows give no languages.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), letters(F.col(text)).alias("text"))
    words = usable.select("lang", F.explode(F.regexp_extract_all("text", F.lit(rf"\S{{1,{word_chars}}}"), F.lit(0))).alias("word")).groupBy("lang", "word").count()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    found: dict[str, list[str]] = {}
    for r in words.withColumn("rank", rank).where(F.col("rank") <= dict_bytes // 2).orderBy("lang", "rank").collect():  # a word and a space are two bytes at least
        found.setdefault(r["lang"], []).append(r["word"])
    out = {}
    for name, ranked in sorted(found.items()):
        data = [w.encode() for w in ranked]
        ends = list(accumulate(len(w) + 1 for w in data))
        out[name] = b" ".join(data[: bisect_right(ends, dict_bytes)][::-1])
    return out


def _compressors(dicts: dict[str, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    out = []
    for data in dicts.values():
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def letters(text: Column) -> Column:
    """Lower-case letters with one space for all between them: what is compressed. Empty for null and without a letter."""
    return F.coalesce(F.when(text.rlike(r"\p{L}"), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " "))), F.lit(""))


def classify(df: DataFrame, dicts: dict[str, bytes], text: str = "text", level: int = 12, block_bytes: int = 2_000, least_margin: float = 0.0) -> DataFrame:
    """Every row with `lang_pred`, `score`, `margin` and `accepted`.

    The letters of the whole text are compressed with each dictionary, in blocks of `block_bytes` so that a long
    text's own repeats do not stand in for the dictionary, and the smallest sum names the language (ties: settled
    by the strongest level, then by the first name); `least_margin` comes from `learn`. `margin` is what the runner-up takes more, as a share of its
    size, from 0 to 1; `score` turns the byte differences into a share of belief. A row is `accepted` if its margin
    is over `least_margin`: an unsettled tie never is. A null text, or one without a letter, is `und` with score and
    margin 0 and not accepted; the same goes for all rows when there are no dictionaries. With one language its
    margin is 1. Only the dictionaries travel to the tasks (their number times dict_bytes); rows stay where they
    are, so no key can be hot. Columns are kept; a new one gets a trailing `_` where its name is taken.
    """
    names = list(dicts)
    (found, *new) = fresh(df, "_found", "lang_pred", "score", "margin", "accepted")
    kind = "struct<lang:string,score:double,margin:double>"

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tools, strong = _compressors(dicts, level), _compressors(dicts, 19)
        for column in columns:
            pred, score, margin = [], [], []
            for value in column:
                data = value.as_buffer()
                best, share, gap = UNKNOWN, 0.0, 0.0
                if data is not None and len(data) and tools:
                    data = memoryview(data)
                    cuts = range(0, len(data), block_bytes)
                    sizes = [sum(len(t.compress(data[a : a + block_bytes])) for a in cuts) for t in tools]
                    if sizes.count(min(sizes)) > 1:
                        sizes = [sum(len(t.compress(data[a : a + block_bytes])) for a in cuts) for t in strong]
                    low, *rest = sorted(sizes)
                    best = names[sizes.index(low)]
                    share = 1.0 / sum(2.0 ** (-BITS * min(s - low, 1000)) for s in sizes)
                    gap = (rest[0] - low) / rest[0] if rest else 1.0
                pred.append(best)
                score.append(share)
                margin.append(gap)
            yield pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=["lang", "score", "margin"])

    out = df.withColumn(found, F.arrow_udf(run, kind)(letters(F.col(text))))
    for name, field in zip(new, ("lang", "score", "margin"), strict=False):
        out = out.withColumn(name, F.col(found)[field])
    return out.withColumn(new[3], (F.col(new[0]) != UNKNOWN) & (F.col(new[2]) > least_margin)).drop(found)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", share: float = 0.005, **options) -> tuple[dict[str, bytes], float]:
    """Dictionaries, and the margin below which a prediction is to be rejected.

    Three quarters of the labelled rows (by a hash of `key`) are for the dictionaries, see `fit`. All others are
    classified: the margin that all but `share` of those told rightly exceed, halved, is the least margin; 0 if there
    are none. It is counted in steps of 1/STEPS, so that as many counts at most reach the driver. Texts in a language
    that was not learned, or in none, compress about as badly with every dictionary and stay below it.
    """
    (part,) = fresh(labelled, "_part")
    split = labelled.withColumn(part, F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("part")), F.lit(4)))
    dicts = fit(split.where(F.col(part) != 0), text, lang)
    if not dicts:
        return dicts, 0.0
    rest = split.where((F.col(part) == 0) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    told = classify(rest.select(F.col(text).alias("t"), F.col(lang).alias("l")), dicts, "t", **options)
    counts = told.where("l = lang_pred AND margin > 0").groupBy(F.floor(F.col("margin") * STEPS).alias("step")).count().orderBy("step").collect()
    allowed, seen = share * sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen > allowed:
            return dicts, r["step"] / STEPS / 2
    return dicts, 0.0


def held_out(key: Column) -> Column:
    """True for the quarter of keys on which nothing is learned: crc32 of the key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))

