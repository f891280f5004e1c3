import duckdb
import numpy as np
from pyspark.sql import functions as F

from reelspark.llm import catalog, quality


def test_dual_descent_reaches_the_optimum():
    """The gradient of the primal objective vanishes."""
    r = np.random.default_rng(2)
    x = [np.unique(r.integers(0, 12, 5)) for _ in range(60)]
    y, scale, weight = np.where(r.random(60) < 0.5, 1.0, -1.0), r.normal(size=12), np.ones(60)
    rounds, quality.ROUNDS = quality.ROUNDS, 400
    w, b = quality.descend(x, y, scale, weight)
    quality.ROUNDS = rounds
    dense = np.zeros((60, 13))
    for i, f in enumerate(x):
        dense[i, f] = scale[f]
    dense[:, 12] = 1
    full = np.append(w, b)
    slack = np.maximum(0, 1 - y * (dense @ full))
    assert np.abs(full - 2 * quality.COST * dense.T @ (y * slack)).max() < 1e-6


def test_edges(spark):
    texts = [None, "", " ", "plain words here", "LOUD!! WORDS!!", "LOUD!! WORDS!!"]
    docs = quality.featurise(spark.createDataFrame([(i, t, i % 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, y int, score string"))
    one = quality.score(docs, quality.fit(docs.where("y = 1"))).collect()
    assert len(one) == 6 and all(0 <= r["score"] <= 1 for r in one)
    none = quality.score(docs, quality.fit(docs.where("false"))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(docs.where("false"), quality.fit(docs)).collect() == []
    assert len({r["score"] for r in quality.score(docs, quality.fit(docs)).where("doc_id in (0, 1, 2)").collect()}) == 1


def test_chosen_labels(spark):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 1, "x"), (2, 0, "x"), (2, 1, "x"), (3, None, "x"), (4, 7, "x"), (None, 1, "x"), (5, 0, "x")], "doc_id long, quality int, y string")
    assert sorted(map(tuple, quality.chosen(labels).collect())) == [(1, 1), (5, 0)]
    many = spark.range(4000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"))
    some = {r[0] for r in quality.chosen(many, most=1000).collect()}
    assert 850 < len(some) < 1150 and some >= {r[0] for r in quality.chosen(many, most=100).collect()}
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (5, None), (9, "d")], "doc_id long, text string").withColumn("features", F.lit(3))
    assert sorted((r["doc_id"], r["y"]) for r in quality.sample(docs, labels).collect()) == [(1, 1)] * 3 + [(5, 0)]
    assert quality.fit(quality.sample(docs.where("false"), labels))["b"] == 0


def test_few_bytes_to_the_driver(spark):
    r = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{k}" for k in r.integers(0, 30, 20)), i % 2) for i in range(400)]
    docs = quality.featurise(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    size = docs.agg(F.sum(F.octet_length("features"))).first()[0]
    model = quality.fit(docs, size // 4)
    assert np.count_nonzero(model["w"]) < np.count_nonzero(quality.fit(docs)["w"])
    assert all((x["score"] >= 0.5) == bool(x["y"]) for x in quality.score(docs, model).collect())


def test_words_of_equal_shape_are_told_apart(spark):
    r = np.random.default_rng(3)
    word = {0: ["buys", "cash", "pill", "deal", "free"], 1: ["lake", "tree", "moon", "bird", "snow"]}
    rows = [(i, " ".join(r.choice(word[i % 2], 12)), i % 2) for i in range(200)]
    docs = quality.featurise(spark.createDataFrame(rows, "doc_id long, text string, y int"))
    got = quality.score(docs.where("doc_id >= 100"), quality.fit(docs.where("doc_id < 100"))).collect()
    assert len(got) == 100 and all((x["score"] >= 0.5) == bool(x["y"]) for x in got)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    rows = [r for r in catalog.op4_naive_bayes_svm(spark, sf).collect() if r["held_out"] and r["doc_id"] in label]
    for kind in (0, 1):
        own = [r["predicted"] == kind for r in rows if label[r["doc_id"]] == kind]
        assert len(own) > 50 and sum(own) >= 0.95 * len(own)
