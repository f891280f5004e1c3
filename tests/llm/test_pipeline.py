import hashlib

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from reelspark.llm import pii
from test_near import brute  # noqa: I001

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"row": F.lit(1), "_fate": F.lit("x"), "spans": F.lit(2)})
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0, 1, "x", 2), (10**6 + 1, "12 34", "en", "s", 5, 1, "x", 2), (None, "hello there my friend of all", None, None, None, 1, "x", 2)], docs.schema)
    docs = docs.unionAll(extra)
    tables = []
    for i, (_, stage) in enumerate(cp.STAGES):
        tables.append(docs)
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(cp.STAGES) - 1:
            assert docs.columns == tables[0].columns
    texts = [{(r["doc_id"], r["text"]) for r in t.select("doc_id", "text").collect()} for t in tables]
    assert texts[0] - texts[1] == {(10**6, None), (10**6 + 1, "12 34")}
    rows = sorted(texts[1], key=lambda r: (r[0] is None, r[0]))
    ids = [(k if k is not None else 10**9, t) for k, t in rows]
    top = brute(ids)
    assert texts[2] == {r for r, (k, _) in zip(rows, ids, strict=True) if top[k] == k}
    assert texts[3] <= texts[2] and 0 < len(texts[2] - texts[3]) < 0.2 * len(texts[2])
    finder = pii.Finder(pii.fit())
    before, after = dict(texts[3]), dict(texts[4])
    assert before.keys() == after.keys()
    for k, t in after.items():
        assert not pii.base_spans(t) and (t == before[k] or finder([before[k]])["spans"] != [""])
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in docs.collect():
        ids = library.encode(after[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["n_tokens"] == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_and_empty(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
