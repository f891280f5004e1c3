from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from reelspark.llm import near


def bag(text):
    w = (text or "").lower().split()
    return Counter([tuple(w[i : i + 5]) for i in range(len(w) - 4)] or ([tuple(w)] if w else []))


def jaccard(a, b):
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def brute(rows):
    """Smallest id of each row's class, by comparing all that share a shingle."""
    up = {k: k for k, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    bags, where = {k: bag(t) for k, t in rows}, defaultdict(list)
    for k, b in bags.items():
        for s in b:
            where[s].append(k)
    for x, y in {(x, y) for ks in where.values() for x in ks for y in ks if x < y}:
        if jaccard(bags[x], bags[y]) >= 0.8:
            a, b = top(x), top(y)
            up[max(a, b)] = min(a, b)
    return {k: top(k) for k, _ in rows}


def words(r, n):
    return [f"w{x}" for x in r.integers(0, 10**6, n)]


def test_estimates_are_unbiased():
    r, shingle, z = np.random.default_rng(1), near.Shingler(), []
    for _ in range(60):
        base = words(r, 40)
        a, b = (" ".join(base * int(r.integers(1, 9)) + words(r, 60)) for _ in range(2))
        sig = near.packed(near.signatures(*shingle([a, b]), 2))
        j = jaccard(bag(a), bag(b))
        assert near.similarity(shingle([a])[1:], shingle([b])[1:]) == pytest.approx(j)
        z.append(((sig[0] == sig[1]).mean() - j) / np.sqrt(j * (1 - j) / near.SIZE))
    assert abs(np.mean(z)) < 0.5 and 0.6 < np.std(z) < 1.4


def copies(r):
    rows, k = [], 0
    for _ in range(12):
        base = words(r, int(r.integers(30, 200)))
        for _ in range(int(r.integers(1, 9))):
            t = list(base)
            for _ in range(int(r.integers(0, 4))):
                t[int(r.integers(0, len(t)))] = "edit"
            rows.append((k, " ".join(t)))
            k += 1
    return rows


@pytest.mark.parametrize("block", [128, 3])
def test_classes_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = copies(np.random.default_rng(block))
    got = {r["doc_id"]: r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edge_rows(spark):
    long = " ".join(words(np.random.default_rng(3), 60))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, long), (7, long), (8, long + " x"), (None, long), (None, None)]
    docs = spark.createDataFrame([(k, t, "a", k) for k, t in rows], "doc_id long, text string, class_id string, _fate long")
    got = sorted(((r["doc_id"], r["class_id"]) for r in near.classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7), (7, 7), (8, 7), (None, 7), (None, None)], key=str)
    kept = near.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "7", "None"]


def test_nothing_alike_and_empty(spark):
    rows = [(k, " ".join(words(np.random.default_rng(k), 30))) for k in range(20)]
    assert all(r["doc_id"] == r["class_id"] for r in near.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert near.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_brute_force(spark):
    from reelspark.llm import catalog

    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    assert {r["doc_id"]: r["class_id"] for r in catalog.op3_bag_min_hash(spark, sf).collect()} == brute(rows)
