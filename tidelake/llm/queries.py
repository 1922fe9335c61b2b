"""The registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import byte_bpe, conversation_repair, decontaminate, html_text, language, line_dedup, near_dedup, packing, secrets, sharding, url_filter, vector_dedup, whitening
from tidelake.llm.common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    dicts, margin = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    found = language.classify(docs.select("doc_id", "text"), dicts, least_margin=margin)
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    placed = sharding.shuffle_into_shards(docs, 40)
    return placed.withColumn("grown_shard", F.lit(None).cast("int"))


def op4_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return packing.assign(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.digest(F.concat("base", "linked")).alias("spans"),
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


OP6_SQL = r"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i USING (s) WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_shared::INT AS n_shared, n_item::INT AS n_item, n_shared::DOUBLE / n_item AS containment
FROM p JOIN n ON n.id = item_id WHERE n_shared >= ceil(n_item * 0.8 - 1e-9)
"""


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "kept")


def captures_and_changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Dated captures from `pages`, and list changes for their hosts and domains, dated by digests of the names."""

    def digits(c, k):
        return F.conv(F.substring(F.md5(c), k, 6), 16, 10).cast("int")

    def day(n):
        return F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.coalesce(day(digits(F.concat_ws("#", "url", "page_id"), 1) % 365), F.lit("2024-01-01").cast("date")))
    name = url_filter.host(F.col("url"))
    names = pages.select(F.explode(url_filter.domains(name)).alias("entry")).where("entry IS NOT NULL").distinct()
    number = digits(F.col("entry"), 7)
    listed = names.select("entry", number.alias("n")).where("n % 3 = 0")
    stage = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k")
    changes = listed.select("entry", "n", stage).select(
        "entry",
        day(F.col("n") % 90 + F.col("k") * (30 + F.col("n") % 60)).alias("changed_on"),
        F.when(F.col("k") % 2 == 0, "add").otherwise("remove").alias("action"),
        F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), ((F.col("n") + F.col("k") / 2) % 3 + 1).cast("int")).alias("category"),
    )
    return captures, changes


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures, changes = captures_and_changes(spark, sf_dir)
    return url_filter.judge(captures, url_filter.validity(changes))


OP8_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    date '2024-01-01' + (('0x' || substr(md5(concat_ws('#', url, page_id)), 1, 6))::INT % 365)::INT AS fetched_on,
    nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':\d*$', ''), '\.$', ''), '^www\.', ''), '') AS host
  FROM pages),
c AS (
  SELECT *, list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')) AS ups FROM p),
n AS (SELECT DISTINCT unnest(ups) AS entry FROM c WHERE host IS NOT NULL),
l AS (SELECT entry, ('0x' || substr(md5(entry), 7, 6))::INT AS n FROM n),
ch AS (
  SELECT entry, date '2024-01-01' + (n % 90 + k * (30 + n % 60))::INT AS changed_on,
    CASE WHEN k % 2 = 0 THEN 'add' ELSE 'remove' END AS action,
    (['adult', 'malware', 'spam'])[(n + k // 2) % 3 + 1] AS category
  FROM l, range(4) r(k) WHERE n % 3 = 0),
v AS (
  SELECT entry, action, category, changed_on AS valid_from,
    coalesce(lead(changed_on) OVER (PARTITION BY entry, category ORDER BY changed_on), date '9999-12-31') AS valid_to FROM ch),
m AS (
  SELECT c.page_id, c.url, c.fetched_on, c.host, v.entry, v.category, v.valid_from, v.valid_to,
    row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.entry) DESC NULLS LAST, v.category, v.valid_from) AS rn
  FROM c LEFT JOIN v ON v.action = 'add' AND list_contains(c.ups, v.entry) AND c.fetched_on >= v.valid_from AND c.fetched_on < v.valid_to)
SELECT page_id, url, fetched_on, host, entry IS NOT NULL AS blocked, entry, category, valid_from, valid_to FROM m WHERE rn = 1
"""

#: Kind, its rank, its pattern for DuckDB and which matches count.
_DUCK_KINDS = (
    (0, r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)""", "len(regexp_extract(m, {p}, 2)) >= 6"),
    (1, "AKIA[A-Z0-9]{16,}", "true"),
    (2, "[0-9a-f]{24,}", "true"),
    (3, "[A-Za-z0-9/+]{40,}", "len(m) = 40"),
    (4, r"""https?://[^\s"''<>]+""", "true"),
)
_DUCK_PARTS = " UNION ALL ".join(
    f"""SELECT doc_id, {rank} AS rank, x.start AS start, len(x.m) AS n, {keep.format(p=f"'{pattern}'").replace("(m", "(x.m")} AS ok
    FROM (SELECT doc_id, unnest(list_transform(range(1, len(ms) + 1), lambda i: struct_pack(
        m := ms[i], start := list_sum(list_transform(gs[1:i], lambda g: len(g))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda y: len(y))), 0)))) AS x
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gs FROM d))"""
    for rank, pattern, keep in _DUCK_KINDS
)
OP5_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, rank, start::BIGINT AS start, start::BIGINT + n AS stop FROM ({_DUCK_PARTS}) WHERE ok),
w AS (
  SELECT c.* FROM a c WHERE c.rank IN (3, 4)
    AND EXISTS (FROM a WHERE a.doc_id = c.doc_id AND a.rank = 1 AND a.stop >= c.start - 400 AND a.start <= c.stop + 400)
    AND (c.rank = 3 OR EXISTS (FROM a WHERE a.doc_id = c.doc_id AND a.rank IN (0, 3) AND a.stop >= c.start - 400 AND a.start <= c.stop + 400))),
s AS (
  SELECT doc_id, rank, start, stop, (['assign', 'access', 'hex', 'secret', 'endpoint'])[rank + 1] || ':' || start || ':' || stop AS one
  FROM (FROM a WHERE rank < 3 UNION ALL FROM w))
SELECT doc_id,
  count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  sha256(coalesce(string_agg(one, ',' ORDER BY start, rank) FILTER (rank < 3), '')) AS base_sha256,
  coalesce(string_agg(one, ',' ORDER BY start, rank) FILTER (one IS NOT NULL), '') AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY doc_id
"""


def op11_byte_bpe(spark: SparkSession, sf_dir: str, rank_path: str | None = None) -> DataFrame:
    path = rank_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encoder(path, public_tokenizers.PATTERN)
    back = byte_bpe.decoder(path, public_tokenizers.PATTERN)
    coded = table(spark, sf_dir, "documents").select("doc_id", ids("text").alias("ids"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(back("ids"), 256).alias("decoded_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with the faults that the crc32 of `conv_id:turn` picks for one in five each: dropped, emptied, cut, repeated, of another role."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    k = F.col("_k")
    kept = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_k")).where(k != 0)
    return kept.select(
        "conv_id",
        "turn",
        F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(k == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    done = conversation_repair.repair(damaged(rows))
    found = done.summary.join(conversation_repair.digest(done).withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    ids = rows.select(F.col("conv_id").alias("_id")).distinct()
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return out.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE
bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS k
  FROM conversations, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy
  FROM raw WHERE k <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
f AS (
  SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN right(regexp_replace(text, '[ 	-
]+$', ''), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM o),
n AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id),
e(p, letter, c, q) AS (VALUES (0, 'D', NULL, 0), (1, 'D', NULL, 1), (2, 'D', NULL, 2), (3, 'D', NULL, 3), (0, 'R', NULL, 2), (1, 'R', NULL, 2), (2, 'R', NULL, 3), (3, 'R', NULL, 2),
  (0, 'K', 's', 1), (0, 'K', 'u', 2), (1, 'K', 'u', 2), (2, 'K', 'a', 3), (3, 'K', 'u', 2)),
ins(q, piece, made, r) AS (VALUES (0, '', '', 0), (0, 'I', chr(10) || 'user:', 2), (0, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (1, '', '', 1), (1, 'I', chr(10) || 'user:', 2),
  (1, 'II', chr(10) || 'user:' || chr(10) || 'assistant:', 3), (2, '', '', 2), (2, 'I', chr(10) || 'assistant:', 3), (3, '', '', 3), (3, 'I', chr(10) || 'user:', 2)),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, r AS q, {'cost': 3 * len(piece), 'audit': piece, 'made': made} AS best FROM n, ins WHERE q = 0
  UNION ALL
  SELECT dp.conv_id, dp.i + 1, ins.r, min({'cost': best.cost + 3 * len(piece) + CASE letter WHEN 'D' THEN 4 WHEN 'R' THEN 3 ELSE 0 END + CASE WHEN fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END,
      'audit': best.audit || letter || piece,
      'made': best.made || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE e.q WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || text END || ins.made})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN e ON e.p = dp.q AND (e.c IS NULL OR e.c = f.c) AND (e.letter = 'D' OR fault NOT IN ('blank', 'duplicate'))
    JOIN ins ON ins.q = e.q
  GROUP BY dp.conv_id, dp.i, ins.r),
b AS (SELECT dp.conv_id, min(best) AS best FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = n.n WHERE q IN (0, 3) GROUP BY dp.conv_id)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
"""


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_packing": op4_packing,
    "op5_secrets": op5_secrets,
    "op6_decontamination": op6_decontamination,
    "op7_near_dedup": op7_near_dedup,
    "op8_url_filter": op8_url_filter,
    "op9_near_vectors": op9_near_vectors,
    "op10_line_dedup": op10_line_dedup,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op5_secrets": OP5_SQL,
    "op6_decontamination": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op12_conversation_repair": OP12_SQL,
}
