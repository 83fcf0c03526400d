"""Coding by a rank file against the library on whole texts, and round trips."""

import hashlib
import random

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from axolin.llm import byte_bpe

with open(byte_bpe.RANKS, "rb") as f:
    CODER = byte_bpe.Coder(f.read())


def one_by_one(text):
    """The ids of each match of the pattern, as another regular expression engine finds them."""
    return [i for m in regex.finditer(byte_bpe.PATTERN, text) for i in CODER.library._encode_single_piece(m[0])]


TEXTS = [None, "", " ", "a", "It's 12 o'clock,\n\n  we'll see  <|endoftext|> ", "çéü 漢字かな  　x", "\x1c\x1d a\x1f \x85b", "ab" * 70_000, "漢字" * 50_000, "!?" * 90_000, "word\n" * 40_000, "x" + " " * 1_200_000 + "y", "\n" * 1_100_000, "  \t" * 500_000 + "'s end", "a" + "\xa0" * 70_000 + " b c" + " " * 5000]
LONG = 300_000


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_ids_of_whole_texts(k):
    text = TEXTS[k] or ""
    got = CODER.encode(text).tolist()
    assert CODER.library.decode_bytes(got) == text.encode()
    assert got == (CODER.library.encode_ordinary(text) if len(text) < LONG else one_by_one(text))


PIECES = st.lists(st.sampled_from(["a", "bc", "'s", " ", "\n", "\t", "　", "\x1c", "1", "!", "é", "  ", "漢"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9), st.integers(1, 4))
def test_splits_respect_every_match(text, piece, run):
    parts = list(byte_bpe.splits(text, piece, run))
    assert "".join(p for _, p in parts) == text
    ids = [i for whole, p in parts for i in (CODER.library._encode_single_piece(p) if whole else CODER.library.encode_ordinary(p))]
    assert ids == CODER.library.encode_ordinary(text)


def test_pieces_stay_small():
    r = random.Random(3)
    text = " ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 12))) for _ in range(60_000))
    assert max(len(p) for _, p in byte_bpe.splits(text)) < byte_bpe.PIECE + 20


def test_tables_with_odd_rows(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS) if not t or len(t) < LONG] + [(None, "a b"), (4, "a b"), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("given"), F.lit(2).alias("Given_"), F.lit(3).alias("a.b"))
    out = byte_bpe.decode(byte_bpe.encode(docs))
    assert out.columns == ["doc_id", "text", "given", "Given_", "a.b", "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["ids"] == CODER.encode(r["text"] or "").tolist()
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert (r["given"], r["Given_"], r["a.b"]) == (1, 2, 3)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0))).collect() == []
    ids = spark.createDataFrame([([220],), ([],), (None,), ([447],)], "ids array<int>")
    assert [bytes(r["decoded"]) for r in byte_bpe.decode(ids).collect()] == [b" ", b"", b"", CODER.library.decode_bytes([447])]


def test_bytes_that_are_not_utf8(spark):
    odd = spark.sql("SELECT decode(X'61', 'utf-8') AS text").union(spark.sql("SELECT CAST(X'61FF62' AS STRING) AS text"))
    assert [r["ids"] for r in byte_bpe.encode(odd).collect()] == [CODER.encode("a").tolist(), CODER.encode("a�b").tolist()]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = byte_bpe.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = CODER.library.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
