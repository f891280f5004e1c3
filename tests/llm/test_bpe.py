import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import bpe, catalog

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "   \n", "aaaa aaaaa aaaaaaaaaaaaaaaa", "Hello, hello's WORLD 42 don't 'S", "<|endoftext|>İΣΑΣ<|startoftext|> x\x1cy z", "é <|endoftext|>́a　b\x85c",
         "naïve café ÅÅ", "日本語テキスト 한국어", "🙂🙂 ok", "a" * 5000, "x1y2" * 300, "same text", "same text"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == list(range(len(TEXTS)))
    for t, r in zip(TEXTS, rows, strict=True):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    encoder = bpe.Encoder(bpe.load(PATH))
    for t in ("one two three four five six seven", "eight nine <|endoftext|> one two", "three"):
        assert np.frombuffer(encoder([t])[0], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_early_ranks_go_one_at_a_time():
    """A rank whose product takes part in an earlier rank: the leftmost place first, then what it makes possible."""
    tables = {"first": np.arange(256, dtype=np.int32), "last": np.arange(256, dtype=np.int32), "a": np.array([300, 97]), "b": np.array([97, 98]),
              "new": np.array([301, 300], np.int32), "tokens": [""] * 302, "special": {}}
    ids, counts = bpe.PairIndex(tables).encode([b"ababa", b"ab"])
    assert ids.tolist() == [301, 98, 97, 300] and counts.tolist() == [3, 1]  # ab at once makes aba possible


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in catalog.op1_bpe_encode_decode(spark, sf).collect()}
    for k, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall():
        ids = library.encode(t or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(docs, PATH), PATH).select(F.octet_length("ids")).collect() == []
