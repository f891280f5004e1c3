import zlib
from collections import defaultdict

import duckdb

from reelspark.llm import catalog, sharding


def sizes(rows):
    groups = defaultdict(int)
    for _, t in rows:
        groups[t or ""] += len((t or "").encode()) + 1
    return groups


def check(rows, got, shards):
    """Equal texts together, slots gapless, loads as near as the largest group lets them be."""
    text = defaultdict(list)
    for k, t in rows:
        text[k].append(t or "")
    where, slots, loads = {}, defaultdict(list), [0] * shards
    groups = sizes(rows)
    crc = {(zlib.crc32(t.encode()), len(t.encode()) + 1): t for t in groups}
    for r in got:
        t = crc[(r["text_crc32"], r["size"])]
        assert t in text[r["doc_id"]] and where.setdefault(t, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
    assert len(got) == len(rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # Largest first: no shard is above 4/3 of the best possible, which is at least the mean and the largest group.
    best = max(sum(loads) / shards, max(groups.values(), default=0))
    assert max(loads) <= 4 / 3 * best + max(sorted(groups.values())[: len(groups) // 2] or [0])


def test_heap():
    assert sharding.least_loaded([("a", 5), ("b", 4), ("c", 3), ("d", 3)], 2) == {"a": 0, "b": 1, "c": 1, "d": 0}
    assert sharding.least_loaded([], 3) == {}


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "hot" * 50), (4, "hot" * 50), (None, "x"), (5, "é" * 9), (5, "é" * 9), *((10 + i, "t" * i) for i in range(30))]
    docs = spark.createDataFrame([(k, t, "y") for k, t in rows], "doc_id long, text string, shard string")
    check(rows, sharding.shard_by_size(docs, 4).collect(), 4)
    assert sharding.shard_by_size(docs.where("false"), 4).collect() == []


def test_bundles_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLOTS", 8)
    rows = [(i, f"text {i} " + "w" * (i % 40)) for i in range(600)]
    got = sharding.shard_by_size(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    check(rows, got, 3)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    got = catalog.op9_balanced_shards(spark, sf).collect()
    check(rows, got, 16)
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
