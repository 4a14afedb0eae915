"""Byte-level BPE against the library whose rank file it reads."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from handtrace.llm import byte_bpe
from handtrace.llm.byte_bpe import RankCoder, decode_ids, encode_documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def coder():
    return RankCoder(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def texts():
    rng = random.Random(3)
    some = ["", " ", " " * 3000, "a" * 1001, "ab" * 500, "日本語" * 100, "-" * 500 + "=" * 300, "<|endoftext|>", "\r\n\t \x1c x's"]
    some += ["".join(rng.choice("ACGT") for _ in range(1500)), "word " * 4000]
    some += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    some += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x3000), rng.randint(0x10000, 0x1FFFF)]))
                     for _ in range(100)) for _ in range(60)]
    return some


@pytest.mark.parametrize("stretch, query, cached, short", [(200_000, 500_000, 300_000, 64), (50, 40, 20, 3)])
def test_ids(coder, library, monkeypatch, stretch, query, cached, short):
    for name, value in (("STRETCH", stretch), ("QUERY_BYTES", query), ("CACHED", cached), ("SHORT", short)):
        monkeypatch.setattr(byte_bpe, name, value)
    coder.cache.clear()
    some = texts()
    for text, (n, ids_sum, text_sum, ids) in zip(some, coder.encode(some, True)):
        wanted = library.encode_ordinary(text)
        assert ids.tolist() == wanted and n == len(wanted)
        assert ids_sum == hashlib.sha256(" ".join(map(str, wanted)).encode()).hexdigest()
        assert text_sum == hashlib.sha256(text.encode()).hexdigest()


def test_documents(spark, library):
    rows = [(1, "two words", 5), (1, "two words", 5), (2, None, 6), (None, "", 7), (3, "ß é 日本 😀 </s>" * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").withColumn("piece", F.lit("x"))
    got = decode_ids(encode_documents(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(got) == 5 and set(got[0].asDict()) == {
        "doc_id", "text", "piece", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    for r in got:
        wanted = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == wanted and r["n_tokens"] == len(wanted) and r["decoded"] == (r["text"] or "").encode()
    odd = spark.createDataFrame([(None,), ([],), ([50_300],), ([0, 1],)], "ids array<int>")
    assert [r["decoded"] for r in decode_ids(odd.coalesce(1), PATH, PATTERN).collect()] == [None, b"", None, b'!"']


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(docs, PATH, PATTERN).count() == 0
