"""Registered queries against their SQL on the smallest tables, with many small chunks."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from reelspark.session import CHUNK_CONF

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ("t1_history_page", "a2_progress_summary", "w4_numbering_gap", "w7_next_actionable", "w10_silence_run", "w12_bin_batch_reconcile", "w17_take_spans", "w19_consecutive_matches",
         "j2_sample_in_take", "j3_selected_or_latest_take", "j8_request_response", "j11_export_state", "w3_export_peak_space", "a18_speech_frames")


def test_sql_needs_no_session():
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), len(o))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0], timeout=120)
    assert out.returncode == 0, out.stderr


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    spark.conf.set(CHUNK_CONF, "16")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = db.execute(entry.oracle_sql()[name])
    at = [d[0] for d in cur.description]
    want = sorted((tuple(r[at.index(c)] for c in cols) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    spark.conf.unset(CHUNK_CONF)
    assert got == want
