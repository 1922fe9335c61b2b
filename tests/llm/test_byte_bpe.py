"""Byte-level BPE against merges done one by one, and cut texts against whole ones."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import regex
import tiktoken

from tidelake.llm import byte_bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The least rank first, the leftmost among equals."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 30), i) for i in range(len(parts) - 1))
        if rank == 1 << 30:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def brute(text: str, ranks: dict[bytes, int]) -> list[int]:
    return [i for m in regex.findall(PATTERN, text) for i in merged(m.encode(), ranks)]


TEXTS = ["", " ", "a", "I'll say: don't; it's 'sure", "  two\n\n  lines \t\n", "1234abc567 x9", "naïve ÀÉ ß İ́", "\U0001f600\U0001f601 emoji　wide", "日本語の文章。中文", "<|endoftext|> is text", "\x1c\x1d\x85\xa0 x", "a'b'c''s'll", "\x00\x01", "tail   "]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_merges_done_one_by_one(ranks, text):
    assert byte_bpe.encode_text(text, PATH, PATTERN).tolist() == brute(text, ranks)


def test_cut_texts_have_the_ids_of_whole_ones(monkeypatch):
    """Random texts of all kinds of characters, cut as often as can be, with short runs taken as long ones."""
    monkeypatch.setattr(byte_bpe, "LONG_RUN", 3)
    monkeypatch.setattr(byte_bpe, "_RUN", byte_bpe.re.compile(f"[{byte_bpe._WS}]{{3,}}"))
    whole = byte_bpe._encoding(PATH, PATTERN)
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("aZs0'9 .,-_\n\t\x1c\xa0　\x85éλ日٣²\U0001f600́") for _ in range(rng.randrange(60)))
        size = rng.randrange(8)
        cut = list(byte_bpe.parts(text, size))
        assert "".join(p for p, _ in cut) == text
        assert byte_bpe.encode_text(text, PATH, PATTERN, size).tolist() == whole.encode_ordinary(text)


def test_very_long_runs_of_one_kind():
    """2 million spaces overflow the stack of the pattern's engine; letters without a boundary stay one match."""
    text = "word " * 60_000 + " " * 2_000_000 + "x" + "\n" * 1_500_000
    ids = byte_bpe.encode_text(text, PATH, PATTERN)
    assert byte_bpe._encoding(PATH, PATTERN).decode_bytes(ids.tolist()) == text.encode()
    assert all(len(p) < 1_000_000 or single for p, single in byte_bpe.parts(text))
    one = byte_bpe.encode_text("ab" * 400_000, PATH, PATTERN)
    assert one.tolist() == byte_bpe._encoding(PATH, PATTERN).encode_ordinary("ab" * 400_000)


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "x" * 300_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    encode, decode = byte_bpe.encoder(PATH, PATTERN), byte_bpe.decoder(PATH, PATTERN)
    got = df.select("doc_id", "ids", encode("text").alias("IDS2"), decode(encode("text")).alias("back")).collect()
    assert [(r[0], r[1], bytes(r[3])) for r in got] == [(i, 7, (t or "").encode()) for i, t in rows]
    assert got[2]["IDS2"] == got[3]["IDS2"] and got[0]["IDS2"] == got[1]["IDS2"] == []
    assert df.limit(0).select(encode("text")).count() == 0
    bytes_of = spark.createDataFrame([([0, 1],), ([],), (None,)], "ids array<int>").select(decode("ids")).collect()
    assert [None if r[0] is None else len(bytes(r[0])) for r in bytes_of] == [2, 0, None]


def test_query(spark, ranks):
    """Every row of the smallest table by the library on whole texts."""
    enc = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = queries.op11_byte_bpe(spark, DIR).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
