"""The corpus pipeline over `documents`: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage is (spark, docs, sf_dir) -> DataFrame and works on all that the one before it kept. It takes the columns of
`documents` from `docs`, whatever else is there, and returns these; the last one returns pieces. Rows of one key and text are one
document, answered alike; an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import decontaminate, language, line_dedup, near_dedup, packing
from tidelake.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the dictionaries tell; an unlabelled one gets it. Null and letterless texts go,
    and those of too narrow a margin. Without labels no language is learned and none is told."""
    docs = docs.select(*COLUMNS)
    dicts, margin = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    told = language.classify(docs, dicts, least_margin=margin).where("accepted")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay elsewhere in the corpus; `n_chars` follows the text. A null text stays
    null, blank lines stay, and a document that loses every line has an empty text."""
    return line_dedup.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal or nearly equal texts. Null texts stay, texts of under five words equal only their copies."""
    return near_dedup.dedup(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`; null texts and those of under five words hold none."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in sequences of 4096 tokens; a null or empty text is the end id alone."""
    cut = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.assign(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("language", keep_known_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack),
]

#: Compression, sampling and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
