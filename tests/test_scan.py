"""Chunked scans against a plain loop, for every chunk width and with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from reelspark.operators.scan import Scan, chunk_of, scan

SPEC = dict(lag={"prev": F.col}, total=None)


def data(seed, n=300):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3]), i, r.choice([None, 0, 1, 5, 7]), r.random() < 0.2, r.random() < 0.5) for i in r.sample(range(1000), n)]


def spec():
    c = F.col
    return Scan(lag={"prev": c("v")}, total={"sum": F.coalesce(c("v"), F.lit(0)).cast("long")}, top={"top": c("v")}, last={"seen": c("v")},
                run={"run": (c("v"), c("reset"), c("keep"))})


def expected(rows):
    out, st = {}, {}
    for k, i, v, reset, keep in sorted(rows, key=lambda x: (x[0], x[1])):
        s = st.setdefault(k, {"prev": None, "sum": 0, "top": None, "seen": None, "run": 0})
        out[(k, i)] = tuple(s[n] for n in ("prev", "sum", "top", "seen", "run"))
        s["prev"] = v
        s["sum"] += v or 0
        s["top"] = v if s["top"] is None else s["top"] if v is None else max(s["top"], v)
        s["seen"] = v if v is not None else s["seen"]
        s["run"] = (s["run"] + (v or 0)) if not reset else ((v or 0) if keep else 0)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, i long, v long, reset boolean, keep boolean")


def got(df):
    return {(r.k, r.i): (r.prev, r["sum"], r.top, r.seen, r.run) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 7, 100, 5000])
def test_scan_equals_loop(spark, width):
    rows = data(width)
    df = frame(spark, rows).withColumn("chunk", chunk_of("i", width))
    assert got(scan(df, ["k"], ["i"], "chunk", spec())) == expected(rows)
