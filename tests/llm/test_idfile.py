import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import catalog, idfile
from reelspark.llm.common import written

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
library = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def wanted(rows):
    out, start = [], 0
    for doc, text in rows:
        ids = ids_of(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 512, 513, 70_000])
@pytest.mark.parametrize("most", [1, 3, 50_257, 300_000])
def test_round_trip(n, most):
    ids = np.random.default_rng(n).zipf(1.3, n) % most
    data = idfile.squeezed(ids, most)
    assert (idfile.expanded(data, n, most) == ids).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=900), st.integers(1, 30))
def test_round_trip_of_runs(ids, times):
    ids = np.array(ids * times, np.int64)
    assert (idfile.expanded(idfile.squeezed(ids, 41), len(ids), 41) == ids).all()


def test_contexts_help():
    rng = np.random.default_rng(1)
    rare = np.where(rng.random(200_000) < 0.9, 7, rng.integers(0, 50_000, 200_000))
    assert len(idfile.squeezed(rare, 50_000)) < 0.3 * 2 * len(rare)
    turns = np.tile(rng.integers(0, 50_000, 500), 400)  # known from the ids before alone
    assert len(idfile.squeezed(turns, 50_000)) < 0.1 * 2 * len(turns)


def test_block_checksums():
    ids = np.arange(3000) % 70
    data = idfile.block(ids, [5, None], [1000, 2000])
    got = idfile.unblock(data)
    assert (got[0] == ids).all() and got[1:] == ([5, None], [1000, 2000], 0, False)
    for at in random.Random(2).sample(range(len(data)), 40):
        bad = data[:at] + bytes([data[at] ^ 4]) + data[at + 1 :]
        with pytest.raises(ValueError, match="damaged"):
            idfile.unblock(bad)


def test_checksums_of_parts():
    rng = random.Random(3)
    data = rng.randbytes(4000)
    for cut in (0, 4, 400, 3996, 4000):
        assert idfile.shifted(zlib.crc32(data[:cut]), 4000 - cut) ^ zlib.crc32(data[cut:]) == zlib.crc32(data)


def test_encoder_is_the_library():
    texts = ["", "Hello  world\n\n x", "<|endoftext|>a<|endoftext|>", "it's 12 ½ ²", "漢字" * 200, "\t   x ", "é" * 300, "a" * 100 + " b", "🙂🙂", "x\u0000y", "ſ K' s", " a", "  a  b   c \n d\n e\n  f ", "a \n\tb\u00a0 c \x1c d\u2003 e", "don't  we'll ", "a <|endoftext|> b c", " ", "<|endoftext|>", "\u0085 x"]
    encode = idfile.Encoder(PATH)
    for _ in range(2):
        assert [[*x.tolist(), 0] for x in encode(texts)] == [ids_of(t) for t in texts]
    assert max(map(len, [*encode.units.place, *encode.pieces.place])) <= idfile.LONGEST


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(" \n\ta1.'sß漢½\u00a0\x1c\u0301,"), max_size=30), max_size=4))
def test_encoder_on_odd_texts(texts):
    assert [[*x.tolist(), 0] for x in shared(texts)] == [ids_of(t) for t in texts]


shared = idfile.Encoder(PATH)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()]
    assert sorted(map(tuple, catalog.QUERIES["op11_context_mixing_files"](spark, SF).collect())) == wanted(rows)


def test_nulls_ties_long_texts_extra_columns(spark):
    rng = random.Random(7)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "δ"]) + str(rng.randrange(99)) for _ in range(6000))
    rows = [(None, "no id"), (1, None), (2, ""), (3, long), (4, "short"), (4, "short"), (5, "a"), (5, "b"), (6, long + long), (7, "end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "file": F.lit("x"), "n": F.lit(0)})
    table = written(idfile.files(df, PATH, size=5000), "ids")
    got = sorted((tuple(r) for r in idfile.documents(table).collect()), key=lambda r: r[1])
    by_hash = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    assert got == wanted(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, by_hash[r[1]])))
    assert table.count() > 8 and table.agg(F.max("n")).first()[0] <= 5000
    parts = idfile.read(table, ids=True).where("doc_id = 6").orderBy("part").collect()
    assert np.frombuffer(b"".join(r["ids"] for r in parts), "<u4").tolist() == ids_of(long + long)
    assert idfile.documents(written(idfile.files(df.where("false"), PATH), "ids")).collect() == []


def test_each_different_string_is_looked_up_once(monkeypatch):
    sizes, at = [], idfile.Ids.at
    monkeypatch.setattr(idfile.Ids, "at", lambda self, strings: sizes.append(len(strings)) or at(self, strings))
    text = "some word, and some word. " * 500
    assert [*idfile.Encoder(PATH)([text])[0].tolist(), 0] == ids_of(text)
    assert max(sizes) < 12


def test_memory_holds_words_without_signs_and_lines():
    rng = random.Random(4)
    words = ["".join(rng.choices("aeionrst", k=7)) for _ in range(40)]
    text = " ".join(rng.choice(words) + rng.choice([",", ".\n", ".", "!?\n", ""]) + rng.choice(words).title() for _ in range(3000))
    text = text.replace(".A", ". A")
    encode = idfile.Encoder(PATH)
    assert [[*x.tolist(), 0] for x in encode([text])] == [ids_of(text)]
    lines = " ".join(f"{rng.choice(words)}.\n{rng.choice(words)}{rng.choice(',;:!?')}" for _ in range(3000))
    known = len(encode.units.place) + len(encode.words.strings)
    assert [[*x.tolist(), 0] for x in encode([lines])] == [ids_of(lines)]
    assert len(encode.units.place) + len(encode.words.strings) <= known + 2 * len(words) + 20  # 1500 lines' ends and more before


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(idfile, "WORDS", 100)
    encode = idfile.Encoder(PATH)
    for k in range(6):
        texts = [f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}{'abcdef'[k]} end don't{k}\nx" + " é" * 60 + " y" * 3 + " " + "q" * 70 for i in range(80)]
        assert [[*x.tolist(), 0] for x in encode(texts)] == [ids_of(t) for t in texts]
        assert len(encode.words.strings) <= 200 and max(len(w) for w in encode.words.strings.to_pylist()) <= idfile.LONGEST


def test_a_worker_keeps_its_encoder(spark):
    df = spark.range(4, numPartitions=1).selectExpr("id as doc_id", "concat('text ', id) as text")
    idfile.files(df, PATH).count()

    def probe(batches):
        import pyarrow as pa

        import reelspark.llm.idfile as own

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(own._RESTING)]})

    assert sum(r["n"] for r in spark.range(64, numPartitions=64).mapInArrow(probe, "n long").collect()) > 0
