import base64
import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from reelspark.llm import catalog, warc

ROWS = [(3, "http://a/ b", "same"), (1, "http://c", "same"), (2, None, None), (5, "http://d", ""), (4, "http://e\r\nX: y", "é" * 200 + "\r\n\r\nWARC/1.1\r\n"), (6, "u", "x" * 1000), (7, "u", "x" * 1000), (None, "u", "same"), (3, "http://a/ b", "same")]


def expected(rows):
    least = {}
    for k, _, h in rows:
        if k is not None:
            least[h or ""] = min(k, least.get(h or "", k))
    out = []
    for k, _, h in rows:
        data = (h or "").encode()
        repeat = k is not None and least[h or ""] != k
        out.append((k, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if repeat else "response", least[h or ""] if repeat else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 16])
def test_round_trip(spark, chunk):
    pages = spark.createDataFrame([(*r, "x") for r in ROWS], "page_id long, url string, html string, payload string")
    chunks = warc.write_records(warc.plan_records(pages), chunk=chunk).cache()
    got = warc.read_records(chunks).collect()
    assert all(r["intact"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(ROWS)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= chunk + 700
    # The rows in order are one stream that any reader can take apart by its lengths.
    stream, records = b"".join(bytes(r["data"]) for r in chunks.orderBy("record_no", "chunk_no").collect()), 0
    while stream:
        head, _, rest = stream.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1") and b"X" not in fields
        n = int(fields[b"Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        stream, records = rest[n + 4 :], records + 1
    assert records == len(ROWS)


def test_long_urls(spark):
    rows = [(1, "u" * 65_536, "a"), (2, " " * 70_000, "é" * 90_000), (3, "é" * 200_000, "a"), (4, "v" * (2 * warc.CHUNK - 500), ""), (5, "w", "b")]
    chunks = warc.write_records(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string"))).cache()
    got = warc.read_records(chunks).collect()
    assert all(r["intact"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 2 * warc.CHUNK + 4
    stream = b"".join(bytes(r["data"]) for r in chunks.orderBy("record_no", "chunk_no").collect())
    assert stream.count(b"WARC/1.1\r\n") == 5 and stream.count(b"WARC-Target-URI: " + "é".encode() * 200_000 + b"\r\n") == 1


def test_long_records_over_many_partitions(spark):
    rows = [(i, f"http://{i}", chr(97 + i % 26) * (50 * i)) for i in range(60)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would else be read by one task
    try:
        chunks = warc.write_records(warc.plan_records(spark.createDataFrame(rows, "page_id long, url string, html string")), chunk=100).cache()
        assert chunks.groupBy("record_no").agg(F.count("*").alias("n"), F.max("n_chunks").alias("of")).where("n = of").count() == 60
        got = warc.read_records(chunks).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["intact"] for r in got)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected(rows)


def test_chunks_out_of_turn(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefgh" * 30)], "page_id long, url string, html string")
    chunks = warc.write_records(warc.plan_records(pages), chunk=50)
    with pytest.raises(Exception, match="out of turn"):
        warc.read_records(chunks.where("chunk_no != 2")).collect()
    with pytest.raises(Exception, match="ends before chunk 4"):
        warc.read_records(chunks.where("chunk_no < 4")).collect()


def test_damage_is_seen(spark):
    pages = spark.createDataFrame([(1, "u", "abcdefgh" * 30)], "page_id long, url string, html string")
    chunks = warc.write_records(warc.plan_records(pages), chunk=50)
    broken = chunks.withColumn("data", F.when(F.col("chunk_no") == 2, F.encode(F.lit("X" * 50), "UTF-8")).otherwise(F.col("data")))
    assert [r["intact"] for r in warc.read_records(broken).collect()] == [False]


def test_least_bytes_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.plan_records(pages, 3).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    assert warc.read_records(warc.write_records(warc.plan_records(pages.where("false")))).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()
    got = catalog.op7_warc_round_trip(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)
