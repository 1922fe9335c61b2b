"""Operators on text against brute force, on small and awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidelake.llm import decontaminate, html_text, language, line_dedup, near_dedup, packing, queries, secrets, sharding, url_filter
from tidelake.llm.components import components, joined, shared

DIR = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x" * 50_000), (5, "é́ \U0001f600 ß İ"), (6, "same text of some five words"), (7, "same text of some five words"), (7, "same text of some five words"), (None, "a row without a key, of more than five words")]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, blank, long and repeated texts, a null key, and columns whose names the operators use themselves."""
    names = ["shard", "slot", "TEXT_KEY", "base", "linked", "host", "piece", "start", "length", "ids", "lang_pred", "score", "n_lines", "_h", "id", "key", "k", "t"]
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def plain(got):
    return sorted(map(str, got))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, DIR).select(*want.columns)
    assert plain([tuple(str(v)[:10] if hasattr(v, "strftime") else v for v in r) for r in got.collect()]) == plain([tuple(str(v)[:10] if hasattr(v, "strftime") else v for v in r) for r in want.fetchall()])


# HTML


def test_article_only():
    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=x>menu</a></nav>
      <div class="cookie-notice"><p>We use cookies, and more, and more.</p></div><div id=content><h2>Head &amp; line</h2><p>First  paragraph,
      with commas, and <a href=y>a link</a> in it.<p>Second &eacute;&#233; one, which is long enough to count.</div>
      <aside><p>Sidebar, with, many, commas, of, its, own, and, more, text, than, most.</p></aside>
      <form><p>Search, please</p></form><section id="comments"><p>Reader, says, a, lot, of, things, with, commas, in, them.</p></section><footer>(c)</footer><script>var a="<p>no</p>"</script></body></html>"""
    assert html_text.main_text(page) == "Head & line\nFirst paragraph, with commas, and a link in it.\nSecond éé one, which is long enough to count."


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>a<p>b", "a\nb"), ("<div", ""), ("no markup &lt;", "no markup <"), ("<p>cut &am", "cut &am"), ("<script>x", ""), ("<p>" * 3000 + "deep", "deep"), ("</b></p>x<b>", "x")])
def test_pages_at_the_edge(page, text):
    assert html_text.main_text(page) == text


def test_parts_of_an_article_stay():
    filler = "<p>" + "A paragraph, with commas, that is long enough, to count as text of the page. " * 4 + "</p>"
    page = f"""<div id="menu"><a href=/a>One</a> <a href=/b>Two</a></div><article>{filler}<section class="market-share"><p>Shares rose, he said.</p></section>
      <p>As <math><mi>x</mi></math> grows, <a href=http://x/>links</a> stay.</p><h2>Sources</h2><ul><li><a href=/1>First source</a></li><li><a href=/2>Second source</a></li></ul>
      <div class="share-buttons"><a href=#>Share</a></div></article><div class="related">Other, things</div>"""
    got = html_text.main_text(page).split("\n")
    assert got[1:] == ["Shares rose, he said.", "As x grows, links stay.", "Sources", "First source", "Second source"]


def test_score_finds_the_container_without_article_tags():
    """Pages without `article` or `main`: the container of long, comma-rich paragraphs wins over lists of links."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    for n in range(2, 12):
        blocks = [f"{word()} " + ", ".join(" ".join(word() for _ in range(9)) for _ in range(6)) + "." for _ in range(n)]
        links = "".join(f"<li><a href='/{i}'>{word()} {word()}</a></li>" for i in range(30))
        page = f"<body><div class=top><ul>{links}</ul></div><div><div id=c{n}>" + "".join(f"<p>{b}</p>" for b in blocks) + f"</div><div class=side><ul>{links}</ul></div></div><div class=bottom>{word()} <a href=/>{word()}</a></div></body>"
        assert html_text.main_text(page) == "\n".join(blocks)


def test_unmatched_end_tags_take_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        html_text.main_text("<p>" + "<span>" * n + "x</i></b></div>" * n)
        return time.perf_counter() - began

    took(100)
    assert took(20_000) < 40 * max(took(2_000), 0.01)


def test_every_page_has_a_row(spark):
    pages = spark.createDataFrame([(1, None), (1, "<p>a"), (1, "<p>a")], "page_id int, html string").withColumn("text", F.lit("mine"))
    got = html_text.extract(pages).collect()
    assert sorted((r["text"], r["text_"]) for r in got) == [("mine", ""), ("mine", "a"), ("mine", "a")]
    assert html_text.extract(pages.limit(0)).count() == 0


# Language


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dicts, margin = language.learn(docs.where(~language.held_out(F.col("doc_id"))))
    odd_texts = ["xq zzk wvw jjqx pplk qq zzw vvk " * 3, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u306f\u3053\u3053\u306b\u3042\u308a\u307e\u3059" * 3, "Suomen kieli kuuluu uralilaisten kielten ryhm\u00e4\u00e4n ja sit\u00e4 puhuu noin viisi miljoonaa", "kjhsdf lkjh wer sdlfkj lkjsdf oiuwer lkjsdf mnbxcv uiwer kjsdhf"]
    assert margin > 0 and not language.classify(spark.createDataFrame([(t,) for t in odd_texts], "text string"), dicts, least_margin=margin).where("accepted").count()
    clean = language.classify(docs.where(language.held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") > 100)), dicts, least_margin=margin)
    assert clean.agg(F.avg(F.col("accepted").cast("int"))).first()[0] > 0.99
    assert all(0 < len(d) <= 65_536 for d in dicts.values())
    told = language.classify(docs.where(language.held_out(F.col("doc_id"))), dicts).where(F.length("text") > 40)
    right, n, low, high = told.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.min("score"), F.max("score")).first()
    assert n > 150 and right > 0.95 and 0 <= low <= high <= 1


def test_language_of_odd_rows(spark, odd):
    dicts = {"a": b"the same text of some words " * 20, "b": b"der gleiche satz mit worten " * 20}
    got = language.classify(odd, dicts).select("doc_id", "lang_pred_", "score_", "accepted").collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) and by[6]["lang_pred_"] == "a" and by[6]["accepted"]
    assert all(by[i]["lang_pred_"] == "und" and not by[i]["accepted"] and by[i]["score_"] == 0 for i in (1, 2, 3))
    none = language.classify(odd, language.fit(odd.withColumn("lang", F.lit(None).cast("string"))))
    assert {r[0] for r in none.select("lang_pred_").collect()} == {"und"}
    marks = language.classify(spark.createDataFrame([("\u0301\u0302 12",)], "text string"), dicts).first()
    assert marks["lang_pred"] == "und" and marks["score"] == 0


# Sharding


def test_shards_are_exact_and_uniform(spark):
    n = 4_003
    got = sharding.shuffle_into_shards(spark.range(n).repartition(7), 40, cell_rows=30).collect()
    assert sorted(r["id"] for r in got) == list(range(n))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 40
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s])) for s in sizes)
    place = {r["id"]: r["shard"] * 101 + r["slot"] for r in got}
    assert abs(np.corrcoef(range(n), [place[i] for i in range(n)])[0, 1]) < 0.06


def test_matrix_rows_add_up():
    before, cells = np.array([0, 5, 5, 105, 130]), np.array([50, 0, 79, 1])
    rows = np.array([sharding.matrix_row(i, before, cells, 9) for i in range(4)])
    assert (rows.sum(1) == np.diff(before)).all() and (rows.sum(0) == cells).all()
    many = [sharding.matrix_row(0, np.array([0, 40, 100]), np.array([50, 50]), s)[0] for s in range(3000)]
    assert abs(np.mean(many) - 20) < 0.3 and abs(np.var(many) - 40 * 0.25 * 60 / 99) < 0.7
    rng = np.random.default_rng(1)
    big = [sharding._hypergeometric(rng, 2 * 10**9, 6 * 10**9, 4000) for _ in range(2000)]
    assert abs(np.mean(big) - 1000) < 3 and abs(np.var(big) / 750 - 1) < 0.15


def test_sharding_odd_rows(spark, odd):
    got = sharding.shuffle_into_shards(odd, 3)
    assert got.count() == len(ODD) and {"shard", "slot", "shard_", "slot_"} <= set(got.columns)
    assert sharding.shuffle_into_shards(odd.limit(0), 3).count() == 0


# Packing


def test_ids_equal_the_tokenizer():
    texts = ["", "It's a TEST: don't 12.5 wOrds", "plain ÀÉ ª º ²½ a--b_c £5", "ﬁ ΑΣ é́ 你好 \x1c x", "<|endoftext|> a<|b", "\t\r\n x", None, "z" * 3000]
    e, t = packing.WordEncoder(TOKENIZER, 1), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):
        ids, ends = e.encode(pa.array(texts))
        for i, x in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]


def brute_fullest(lengths, room):
    sums = {0}
    for x in lengths:
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_bins_are_fullest():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts = Counter(rng.integers(1, 40, 12).tolist())
        used = packing.fullest(counts, 60)
        lengths = list((counts - Counter({max(counts): 1})).elements())
        assert sum(k * n for k, n in used) == max(counts) + brute_fullest(lengths, 60 - max(counts))
        assert all(n <= counts[k] for k, n in used)


def test_packing_round_trip(spark, odd):
    got = packing.pack(odd.drop("start"), TOKENIZER, capacity=64).collect()
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 1) for i, x in ODD)
    docs, bins = {}, {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length_"]))
        docs.setdefault(r["doc_id"], []).append((r["piece_"], r["start"], np.frombuffer(r["ids_"], "<u4").tolist()))
    assert sum(len(x[2]) for v in docs.values() for x in v) == sum((len(k) - 1) * n for k, n in want.items())
    for i in (1, 2, 4, 5):
        assert (i, *(y for x in sorted(docs[i]) for y in x[2])) in want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(odd.limit(0).drop("start"), TOKENIZER).count() == 0


# Secrets


def test_linked_parts(spark):
    key, secret = "AKIA" + "B" * 16, "abcdEFGH1234/+" + "z" * 26
    rows = [(1, f"id {key} then {secret} at https://h.example/x"), (2, f"only {secret} and https://h.example/x"), (3, key + " " * 1000 + secret), (4, None), (5, "token: short password = 'longer-value' " + "0123456789abcdef" * 2)]
    got = {r["doc_id"]: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("d", secrets.digest(F.col("linked"))).withColumn("b", secrets.digest(F.col("base"))).collect()}
    assert got[1]["d"] == "secret:29:69,endpoint:73:92" and got[1]["b"] == "access:3:23"
    assert got[2]["d"] == got[3]["d"] == got[4]["b"] == "" and got[2]["b"] == ""
    assert got[5]["b"] == "assign:13:37,hex:39:71"


def test_secrets_of_odd_rows(spark, odd):
    assert secrets.scan(odd).count() == len(ODD)


# Decontamination


def word_sets(text, n=5):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_contained_items(spark):
    words = [f"w{i}" for i in range(400)]
    item = " ".join(words[100:130])
    docs = [(1, " ".join(words)), (2, " ".join([*words[:120], "x", *words[120:]])), (3, " ".join(words[:115])), (4, None), (5, item.upper().replace(" ", ", ")), (5, item), (6, "w1")]
    items = [(10, item), (10, item), (11, "too short"), (12, None), (13, " ".join(words[0:5]))]
    got = decontaminate.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i) for d, t in docs for i, q in items if word_sets(q) and len(word_sets(q) & word_sets(t)) >= 0.8 * len(word_sets(q))}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and (1, 13) in want
    left = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in left.collect()} == {4, 6}


def test_decontamination_of_odd_rows(spark, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, none).count() == len(ODD)
    items = spark.createDataFrame([(1, "same text of some five words")], "item_id long, text string")
    assert decontaminate.decontaminate(odd, items).count() == len(ODD) - 3


# Near duplicates


def brute_groups(docs):
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in docs for w in [re.findall(r"[^\W_]+", t.lower())]}
    df = Counter(g for s in sets.values() for g in s)
    w = {i: {g: n * (1 + math.log(len(docs) / df[g])) for g, n in s.items()} for i, s in sets.items()}
    texts, root = dict(docs), {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b:
                low = sum(min(v, w[b].get(g, 0)) for g, v in w[a].items())
                total = sum(w[a].values()) + sum(w[b].values()) - low
                if texts[a] == texts[b] or total and low >= 0.8 * total:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in documents.where("text IS NOT NULL").collect()]
    base = docs[5][1].split()
    for k in range(6):  # near copies of one text
        docs.append((10_000 + k, " ".join([*base[: 3 + 20 * k], "changed", *base[3 + 20 * k :]])))
    got = near_dedup.clusters(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == brute_groups(docs)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


@pytest.mark.parametrize("block, weight", [(1_000, 4_000_000), (8, 4_000_000), (1_000, 2_000)])
def test_a_vast_family_equals_brute_force(spark, monkeypatch, block, weight):
    """Near copies of one text, nearer and farther, in large buckets: comparison by blocks, of few or light texts too, loses no link."""
    monkeypatch.setattr("tidelake.llm.components.SMALL_BUCKET", 4)
    monkeypatch.setattr("tidelake.llm.components.BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK_WEIGHT", weight)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 400, 150)]
    docs = []
    for k in range(90):
        own = list(base)
        for i in rng.choice(150, k // 12, replace=False):
            own[i] = f"x{k}y{i}"
        docs.append((k, " ".join(own)))
    docs += [(1_000 + k, " ".join(f"z{k}{i}" for i in range(60))) for k in range(30)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.clusters(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute_groups(docs)
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(docs) and all(want[got[i]] == want[i] for i in got)


@pytest.mark.parametrize("bits, part", [(1 << 28, 500_000), (1 << 20, 300)])
def test_weights_are_plain_tf_idf(spark, bits, part):
    """Exact frequencies of the texts asked for, with a filter that is all but full too, and in many parts; sampling sees no less."""
    docs = [" ".join(f"w{(i * k) % 97}" for k in range(1, 30)) for i in range(1_300)] + ["a b c d e f"] * 50 + [" ".join(f"u{i}x{k}" for k in range(9)) for i in range(20)]
    df = Counter(g for t in docs for g in word_sets(t))
    frame = spark.createDataFrame([(t,) for t in [*docs, None, "", "too short"]], "t string").repartition(3)
    n = len(docs) + 2  # two without shingles
    bounds = near_dedup.fit(frame, "t")
    asked = docs[::7] + docs[-30:]
    rows = near_dedup.frequencies(frame, "t", spark.createDataFrame([(t.encode(), t) for t in set(asked)], "id binary, t string"), bounds.documents, bits, part).collect()
    assert bounds.documents == n and {r["t"] for r in rows} == set(asked)
    for r in rows:
        assert r["id"] == r["t"].encode()
        w = r["t"].split()
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        assert math.isclose(r["weight"], sum(1 + math.log(n / df[g]) for g in grams))
        _, h, _ = near_dedup.counted(*near_dedup.shingles(pa.array([r["t"]])))
        assert sorted(near_dedup._unpacked(pa.array([r["df"]])).tolist()) == sorted(df[g] for g in set(grams))
        assert (bounds.of(h, np.ones(len(h))) <= 1 + np.log(n / near_dedup._unpacked(pa.array([r["df"]]))) + 1e-12).all()


def test_groups_of_the_whole_table_equal_brute_force(spark):
    """Over a thousand documents: links hold under plain TF-IDF, and only these."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL").collect()]
    base = [t.split() for _, t in rows if 60 <= len(t.split()) <= 400][:40]
    for k, w in enumerate(base):  # edits from a few to beyond the limit
        for j in range(6):
            own = list(w)
            for at in range(j, len(own), max(1, len(own) // (1 + j))):
                own[at] = f"x{k}y{at}"
            rows.append((1_000_000 + 10 * k + j, " ".join(own)))
    assert len(rows) > 1_000
    sets = {i: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) for i, t in rows for w in [re.findall(r"[^\W_]+", t.lower())]}
    df = Counter(g for s in sets.values() for g in s)
    weight = {i: {g: n * (1 + math.log(len(rows) / df[g])) for g, n in s.items()} for i, s in sets.items()}
    total = {i: sum(w.values()) for i, w in weight.items()}
    order, links, at = sorted((i for i in total if total[i]), key=total.get), [], 0
    for k, b in enumerate(order):
        while total[order[at]] < 0.8 * total[b] - 1e-9:
            at += 1
        for a in order[at:k]:
            low = sum(min(v, weight[b].get(g, 0)) for g, v in weight[a].items())
            if low >= 0.8 * (total[a] + total[b] - low) - 1e-9:
                links.append((a, b))
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    first = {}
    for a, b in [*links, *((first.setdefault(t, i), i) for i, t in rows)]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert len({i for i, _ in rows}) == len(rows) == len(got)
    assert all(find(i) == find(got[i]) for i in got)  # no link that does not hold
    assert sum(got[i] == find(i) for i in got) >= 0.99 * len(got)  # bands miss few


def test_near_dedup_of_odd_rows(spark, odd):
    kept = near_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted(["1", "2", "3", "4", "5", "6", "None"])
    assert near_dedup.dedup(odd.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 103), (103, 101), (7, 7), (None, 3)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 103: 100}


# Lines


def test_lines(spark):
    long = "this line is about the harbour and the prices that the market pays for grain in spring"
    docs = [(1, f"{long}\nshort\nonly here, and nowhere else in this corpus"), (2, f"{long.upper()}  \nshort\nshort"), (3, f"{long.replace('harbour', 'harbor')}\nanother line that stands alone in this corpus"), (4, None), (5, long), (5, long)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    by = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got}
    assert by[1] == (docs[0][1], 3, 0) and by[2] == ("", 3, 3) and by[3] == ("another line that stands alone in this corpus", 2, 1)
    assert by[4] == (None, 0, 0) and by[5] == ("", 1, 1) and len(got) == len(docs)
    kept = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_chars=10).where("doc_id = 2").first()
    assert (kept["text"], kept["n_dropped"]) == ("short\nshort", 1)


def test_lines_of_odd_rows(spark, odd):
    got = line_dedup.dedup_lines(odd)
    assert got.count() == len(ODD) and {r["doc_id"]: r["text"] for r in got.select("doc_id", "text").collect()}[4] == "x" * 50_000
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# URLs


def test_hosts(spark):
    urls = ["http://www.A.example.com:80/x", "https://u:p@b.example./", "ftp://c.example?q", "/relative", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(url_filter.host(F.col("u")).alias("h")).collect()
    assert [r["h"] for r in got] == ["a.example.com", "b.example", "c.example", None, None, None]


def test_entries_hold_as_of_the_fetch(spark):
    changes = spark.createDataFrame([("x.org", "2024-01-10", "add", "spam"), ("x.org", "2024-02-01", "remove", None), ("a.x.org", "2024-01-15", "add", "adult"), (None, "2024-01-01", "add", "s"), ("y.org", "2024-01-01", "drop", "s"), ("x.org", "2024-02-01", "add", "spam")], "entry string, changed_on string, action string, category string").withColumn("changed_on", F.col("changed_on").cast("date"))
    caps = spark.createDataFrame([(1, "http://b.x.org/", "2024-01-09"), (2, "http://b.x.org/", "2024-01-10"), (3, "http://b.x.org/", "2024-02-01"), (4, "http://a.x.org/", "2024-03-01"), (4, "http://a.x.org/", "2024-03-01"), (5, None, "2024-03-01"), (6, "http://y.org", None)], "page_id int, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date")).withColumn("host", F.lit("mine"))
    got = url_filter.judge(caps, url_filter.validity(changes)).collect()
    assert sorted((r["page_id"], r["entry"] or "", r["blocked"]) for r in got) == [(1, "", False), (2, "x.org", True), (3, "", False), (4, "a.x.org", True), (4, "a.x.org", True), (5, "", False), (6, "", False)]
    assert url_filter.judge(caps, url_filter.validity(changes.limit(0))).where("blocked").count() == 0


def test_deep_hosts_and_lists_apart(spark):
    changes = spark.createDataFrame([("example.com", "2024-01-01", "add", "spam"), ("example.com", "2024-02-01", "add", "adult"), ("example.com", "2024-03-01", "remove", "adult"), ("example.com", "2024-05-01", "remove", None)], "entry string, d string, action string, category string").select("entry", F.to_date("d").alias("changed_on"), "action", "category")
    rows = [(i, "http://d.b.c.a.x.example.com/p", d, "mine") for i, d in enumerate(("2023-12-31", "2024-01-05", "2024-02-05", "2024-04-01", "2024-05-01"))]
    caps = spark.createDataFrame(rows, "page_id int, url string, d string, entry string").withColumn("fetched_on", F.to_date("d"))
    got = url_filter.judge(caps, url_filter.validity(changes)).orderBy("page_id").collect()
    assert [(r["entry_"], r["category"]) for r in got] == [(None, None), ("example.com", "spam"), ("example.com", "adult"), ("example.com", "spam"), (None, None)]
    assert {r["entry"] for r in got} == {"mine"}


def test_many_matches_in_one_text(spark):
    """A hundred thousand hex runs in one text: spans as Python finds them, in seconds."""
    text = " ".join(f"é{i:024x}" for i in range(100_000))
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), F.sha2(secrets.digest(F.col("base")).cast("binary"), 256).alias("h")).first()
    want = ",".join(f"hex:{m.start()}:{m.end()}" for m in re.finditer("[0-9a-f]{24,}", text))
    assert (row["n"], row["h"]) == (100_000, hashlib.sha256(want.encode()).hexdigest())


def test_only_the_leaking_text_of_a_key_goes(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, "a clean text of some words without a key"), (7, item), (7, "a clean text of key seven, of some words"), (7, None), (8, item), (8, item)], "doc_id long, text string")
    left = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:7]) for r in left) == [("7", ""), ("7", "a clean"), ("None", "a clean")]


# Digests of the thin queries


def test_query_digests(spark, documents):
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in queries.op3_sharding(spark, DIR).collect():
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 16, zlib.crc32(data), "rows")
    t = Tokenizer.from_file(TOKENIZER)
    for r in queries.op4_packing(spark, DIR).collect():
        ids = [*t.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 1][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(np.array(ids, "<u4").tobytes()) == r["ids_crc32"]
    for r in queries.op5_secrets(spark, DIR).collect():
        base = ",".join(s for s in r["spans"].split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert hashlib.sha256(base.encode()).hexdigest() == r["base_sha256"]


# Large buckets


@pytest.mark.parametrize("sizes", [(1_000, 1_000, 6), (3, 1_000, 6), (3, 8, 2)])
def test_large_buckets_join_every_family(spark, monkeypatch, sizes):
    """Families, and chains, in shared buckets of one and of two bands; numbers within 2 are alike."""
    for name, size in zip(("BLOCK", "VAST_BUCKET", "SMALL_BUCKET"), sizes, strict=True):
        monkeypatch.setattr(f"tidelake.llm.components.{name}", size)
    values = [v for start in range(0, 400, 40) for v in range(start, start + 16, 2)]
    rows = [(v, [1, 2, 1_000 + v]) for v in values] + [(5_000, [1]), (5_001, [3]), *((6_000 + 10 * k, [3]) for k in range(9)), (6_081, [3])]
    members = shared(spark.createDataFrame(rows, "id long, bands array<long>").select(F.explode("bands").alias("key"), "id"))

    def finer(ids):  # two alike numbers share a neighbour
        return ids.select(F.explode(F.array(*(F.col("id") + k for k in (-1, 0, 1)))).alias("key"), "id")

    want = {v: v // 40 * 40 for v in values} | {6_080: 6_080, 6_081: 6_080}
    for refine in (None, finer):
        got = {r["id"]: r["root"] for r in joined(members, lambda pairs: pairs.where("b - a <= 2"), refine=refine).collect()}
        assert {k: v for k, v in got.items() if k < 5_000 or k > 5_001} == want  # these two are alike, but share no band


def brute_lines(rows, similarity=0.8, n=5):
    """Number of groups of distinct normal lines. The prefixes of the shingles in one order find every alike pair."""
    rows = sorted(set(rows))
    sets = [{t[i : i + n] for i in range(len(t) - n + 1)} for t in rows]
    df, places, root = Counter(x for s in sets for x in s), {}, list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, s in enumerate(sets):
        met = set()
        for x in sorted(s, key=lambda x: (df[x], x))[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1]:
            met.update(places.setdefault(x, []))
            places[x].append(i)
        for j in met:
            m = len(s & sets[j])
            if m >= similarity * (len(s) + len(sets[j]) - m) - 1e-9:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return len({find(i) for i in range(len(rows))})


def plain_line(line):
    return re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")


def left_lines(spark, texts, **options):
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options)
    return got.agg(F.sum("n_lines") - F.sum("n_dropped")).first()[0]


def test_lines_of_the_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [x for r in docs.select("text").where("text IS NOT NULL").distinct().collect() for x in r["text"].split("\n")]
    named = [plain_line(x) for x in rows]
    groups, blank = brute_lines([x for x in named if x]), sum(not x for x in named)
    got = left_lines(spark, {r["text"] for r in docs.select("text").where("text IS NOT NULL").collect()}) - blank
    exact = len({x for x in named if x})
    assert exact - got >= 0.98 * (exact - groups) and got >= groups


def test_alike_lines_under_a_shared_heading(spark):
    """Forty lines that share a long heading, two and two alike, and the same by the thousand with the finer keys."""
    rng = np.random.default_rng(11)
    word = lambda k: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), k))
    heading = "announcement of the international quarterly committee concerning agricultural commodities and their prices"

    def pairs(n):
        own = [" ".join(word(k) for k in rng.integers(3, 9, 22)) for _ in range(n)]
        return [x for o in own for x in (f"{heading} {o}", f"{heading} {o[:40]}{word(5)}{o[45:]}")]

    rows = pairs(20)
    assert left_lines(spark, rows) == brute_lines(rows) == 20
    rows = pairs(700)
    assert left_lines(spark, rows) == brute_lines(rows) == 700


def test_families_of_lines_in_shared_buckets(spark):
    """Lines that share a long phrase, in families of over SMALL_BUCKET near copies, against brute force."""
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(500)]
    phrase = "published quarterly reports concerning international agricultural commodities"
    rows = []
    for f in range(12):
        own = list(rng.choice(names, 14))
        rows += [" ".join([phrase, *own[:k], f"x{f}", *own[k:]]) for k in range(0, 14)]
    assert len(rows) == len(set(rows)) == 168 and left_lines(spark, rows) == brute_lines(rows) == 12


def test_edits_of_lines_equal_brute_force(spark):
    """Edits at long words, at the first and last character and in inner spaces, on lines about and below the five-shingle sketch."""
    rng = np.random.default_rng(5)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for n in range(60):
        w = ["".join(rng.choice(letters, k)) for k in rng.permutation([9, 8, 7, 10, 8, *[3] * 14])]
        long = next(i for i, x in enumerate(w) if len(x) > 6)
        rows += [" ".join(w), " ".join(w[:long] + w[long + 1 :]), "Q" + " ".join(w)[1:], " ".join(w)[:-1] + "q", "  ".join(w[:5]) + "\t" + " ".join(w[5:])]
        short = "".join(rng.choice(letters, 13 + n % 9))
        rows += [short, "q" + short[1:], short[:-1] + "q"]
    assert left_lines(spark, rows) == brute_lines(map(plain_line, rows))


def test_unlike_copies_of_a_long_line_are_ruled_out_unread(spark, monkeypatch):
    """A hundred long lines with a common origin, none alike another: the comparison of their buckets leaves few pairs to be read."""
    rng, seen, every = random.Random(11), [], line_dedup.joined
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    origin = [word() for _ in range(145)]
    rows = [" ".join(word() if i in changed else w for i, w in enumerate(origin)) for changed in (set(rng.sample(range(145), 17)) for _ in range(100))]

    def counted(members, verify, *others):
        return every(members, lambda pairs: (seen.append(pairs.count()), verify(pairs))[1], *others)

    monkeypatch.setattr(line_dedup, "joined", counted)
    monkeypatch.setattr("tidelake.llm.components.MANY_OPEN", 0, raising=False)
    assert left_lines(spark, rows) == brute_lines(rows) == 100
    assert sum(seen[1:]) < 1000


def test_components_end_once_they_are_stars(spark, monkeypatch):
    """Stars need no round, a short chain few; every round is jobs and plans that the driver holds."""
    from tidelake.llm import components as module

    rounds, durable = [], module.durable
    monkeypatch.setattr(module, "durable", lambda df: (rounds.append(1), durable(df))[1])
    stars = components(spark.createDataFrame([(1, 2), (3, 1), (7, 5), (5, 5), (None, 1)], "a long, b long"))
    assert sorted(map(tuple, stars.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 5)] and len(rounds) == 1
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert sorted(map(tuple, chain.collect())) == [(i, 0) for i in range(41)]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
