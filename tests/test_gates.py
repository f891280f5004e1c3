"""Gate, silence and bandwidth rules against plain replays and known cases."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from reelspark.catalog import streams
from reelspark.functions import samples
from reelspark.operators import gates, telemetry, timeline
from reelspark.streaming import live, state

SCHEMA = "session_id long, take_id long, seq long, block_start long, block_end long, is_speech boolean, armed long, required long, enforce boolean"


def random_takes(n, seed=1):
    r, rows = random.Random(seed), []
    for s in range(n):
        at, armed, required, enforce = 0, r.choice([0, 100, 700]), r.choice([0, 100, 300, 900]), r.random() < 0.5
        for i in range(r.randint(1, 25)):
            size = r.choice([50, 100, 100, 160])
            rows.append((s // 2, s % 2, i, at, at + size, r.random() < 0.3, armed, required, enforce))
            at += size
    return rows


def replay(rows):
    """Event by event: the rules as stated, one block after the other."""
    out = {}
    for s, take, _, start, end, speech, armed, required, enforce in rows:
        t = out.setdefault((s, take), {"phase": "waiting_for_head_silence", "progress": 0, "passed": 0, "first": 0, "last": 0})
        waiting = t["phase"] == "waiting_for_head_silence"
        if speech and end > armed and not (enforce and waiting):
            t["first"] = t["first"] or max(start, armed, 1)
            t["last"] = end
        if waiting and end > armed:
            t["progress"] = (0 if speech else t["progress"] + end - start) if enforce else end - armed
            if t["progress"] >= required:
                t["passed"] = end if enforce else armed + required
                t["phase"] = "speech_started" if t["first"] else "ready_for_speech"
        elif t["phase"] == "ready_for_speech" and speech and end > armed:
            t["phase"] = "speech_started"
    return {s: (t["phase"], t["passed"], t["first"], t["last"]) for s, t in out.items()}


def as_dict(df):
    return {(r.session_id, r.take_id): (r.phase, r.passed_sample, r.content_started_sample, r.last_signal_sample) for r in df.collect()}


@pytest.mark.parametrize("width", [2, 1000])
def test_gate_equals_replay(spark, width):
    rows = random_takes(200)
    assert as_dict(gates.head_silence_gate(spark.createDataFrame(rows, SCHEMA), width)) == replay(rows)


def test_gate_stream_equals_replay(spark, tmp_path):
    """One micro-batch a file, and the query is started anew from its checkpoint for the last ones."""
    rows = sorted(random_takes(40, seed=3), key=lambda r: r[2])
    folder = tmp_path / "blocks.parquet"

    def run(*parts):
        for lo, hi in parts:
            spark.createDataFrame([r for r in rows if lo <= r[2] < hi], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        return live.drain(spark, state.follow_rule(stream, gates.TAKE, state.HeadSilence()), root=str(tmp_path / "query"))

    run((0, 3), (3, 6))
    out = run((6, 9), (9, 14), (14, 99))
    assert out.groupBy("session_id", "take_id").count().agg(F.max("count")).first()[0] > 1
    assert as_dict(live.latest_rows(out, ["session_id", "take_id"], "seq")) == replay(sorted(rows))


def test_takes_that_share_a_state_value(spark, tmp_path):
    """Takes of a session come mixed, some go on in later batches; each key of the state is four of them."""
    rows = [(s % 3, s // 3, *r[2:]) for s, r in ((2 * r[0] + r[1], r) for r in random_takes(60, seed=5))]
    rows = sorted(((*r[:2], r[2] * 60 + r[1], *r[3:]) for r in rows), key=lambda r: r[2])
    batches = [[r for r in rows if lo <= r[2] < hi] for lo, hi in ((0, 200), (200, 500), (500, 2000))]
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "rows"))
        out = live.drain(spark, state.follow_rule(stream, gates.TAKE, state.HeadSilence(), together=4), root=str(tmp_path / "query"))
    assert as_dict(live.latest_rows(out, gates.TAKE, "seq")) == replay(rows)
    kept = spark.read.format("statestore").option("stateVarName", "rule").load(str(tmp_path / "query" / "checkpoint"))
    assert kept.count() == len({(r[0], r[1] // 4) for r in rows}) == 15


def test_query_keeps_fewer_state_keys_than_takes(spark, monkeypatch):
    roots, drain = set(), live.drain
    monkeypatch.setattr(live, "drain", lambda *a, root, **k: roots.add(root) or drain(*a, root=root, **k))
    takes = streams.x2(spark, "/root/testdata/sf0.01").count()
    kept = spark.read.format("statestore").option("stateVarName", "rule").load(f"{roots.pop()}/checkpoint").count()
    assert takes == 600 and kept == 150  # one a session here


def test_packed_rows_give_what_plain_ones_give(spark, tmp_path, monkeypatch):
    """A rule that answers each row; rows of one key come in several packs and batches."""
    monkeypatch.setattr(state, "PACK", 7)
    rows = [(i % 2, None if i % 11 == 0 else i % 5, i, i, i + 1, None if i % 13 == 0 else float(i % 3)) for i in range(120)]
    schema = "session_id long, take_id long, seq long, block_start long, block_end long, peak double"
    got = [streamed(spark, tmp_path / f"rows{n}", [rows[:50], rows[50:]], schema, lambda s, n=n: state.follow_rule(s, gates.TAKE, state.DigitalSilence(2), n)) for n in (1, 2)]
    assert got[0].count() == 120 and got[0].schema == got[1].schema
    assert sorted(map(str, got[0].collect())) == sorted(map(str, got[1].collect()))


def streamed(spark, folder, batches, schema, make):
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return live.drain(spark, make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))))


def test_fault_latch_stream(spark, tmp_path):
    batches = [[(1, 0, False, False), (2, 0, True, False)], [(1, 1, True, False)], [(1, 2, True, False), (2, 1, True, True)]]
    out = streamed(spark, tmp_path / "rows", batches, "session_id long, seq long, fault boolean, cleared boolean", lambda s: state.follow_rule(s, ["session_id"], state.FaultLatch()))
    assert {r.session_id: r.fault_seq for r in live.latest_rows(out, "session_id", "seq").collect()} == {1: 1, 2: None}


def test_latest_only_waits_for_its_acknowledgement(spark, tmp_path):
    v, a, f = (lambda i: (1, i, "value", None)), (lambda i, n: (1, i, "ack", n)), (lambda i: (1, i, "fault", None))
    batches = [[v(1), v(2), v(3)], [a(4, 7), v(5), a(6, 1)], [a(7, 1), v(8), f(9), a(10, 2), a(11, 2)], [v(12), (2, 13, "ack", 1), (2, 14, "value", None)]]
    out = streamed(spark, tmp_path / "rows", batches, "session_id long, seq long, kind string, ack_id long", lambda s: state.follow_rule(s, ["session_id"], state.LatestOnly()))
    # 1 is in flight, 5 is the newest behind it; the fault passes and removes 8, so 12 goes out once 5 is acknowledged
    assert sorted(map(tuple, out.collect())) == [(1, 1, 1), (1, 5, 2), (1, 9, None), (1, 12, 3), (2, 14, 1)]


def test_discontinuity_streaks(spark, tmp_path):
    rows = [(1, 0, 0, 1000), (1, 480, 10, 1010), (2, 960, 20, 1040), (3, 1000, 30, 2000), (0, 1000, 40, 2010), (1, 1400, 50, 2020)]
    rows = [(1, i, c, s, n) for i, (c, s, _, n) in enumerate(rows)]
    schema = "session_id long, seq long, count long, silence_samples long, now_ms long"
    out = streamed(spark, tmp_path / "rows", [rows[:3], rows[3:]], schema, lambda s: state.follow_rule(s, ["session_id"], state.Discontinuities(48000)))
    assert sorted(map(tuple, out.select("seq", "streak_silence_samples", "show").collect())) == [(2, 480, True), (3, 40, False), (5, 400, False)]


def test_request_without_answer_times_out(spark, tmp_path):
    rows = [("a", "request", 1, 0), ("b", "request", 2, 10), ("a", "request", 3, 20), ("a", "response", 5, 30), ("b", "response", 6, 71), ("z", "tick", 7, 400), ("a", "response", 8, 401), ("z", "request", 9, 402)]
    batches = [[(i, k, n, datetime.datetime.fromtimestamp(1_700_000_000 + s, datetime.UTC), (1_700_000_000 + s) * 1000) for i, k, n, s in part] for part in (rows[:2], rows[2:4], rows[4:6], rows[6:])]
    out = streamed(spark, tmp_path / "rows", batches, "request_id string, kind string, seq long, at timestamp, at_ms long", lambda s: state.answers(s, 60_000, "10 seconds"))
    # each request once: a's by its first response, b's by its timer although a late response came; the last is open
    assert sorted(map(tuple, out.collect())) == [("a", 1, 5, False), ("a", 3, 5, False), ("b", 2, None, True)]


def test_speech_bounds(spark):
    rows = [(10, 200, 80, 120, 20), (70, 130, 80, 120, 20), (10, 50, 0, 0, 20)]
    df = spark.createDataFrame(rows, "a long, b long, f long, l long, p long")
    out = [tuple(r.x) for r in df.select(samples.speech_bounds(*[F.col(c) for c in "abflp"]).alias("x")).collect()]
    assert out == [(60, 140), (70, 130), (10, 50)]


def test_discontinuity_cases(spark):
    cases = {1: [(0, 0, 0), (1, 240, 1000), (2, 480, 1030)], 2: [(0, 0, 0), (1, 480, 1000)],
             3: [(0, 0, 0), (1, 0, 1000), (2, 240, 2000), (3, 480, 3000)], 4: [(0, 0, 0), (2, 300, 1000), (1, 300, 1010), (2, 540, 1040)]}
    rows = [(s, i, c, sil, t) for s, steps in cases.items() for i, (c, sil, t) in enumerate(steps)]
    df = spark.createDataFrame(rows, "session_id long, seq long, count long, silence_samples long, now_ms long")
    for width in (1, 100):
        shown = [(r.session_id, r.seq) for r in telemetry.discontinuity_streaks(df, width, 48_000).where("show").collect()]
        assert sorted(shown) == [(1, 2), (2, 1)]


def tone(parts, n=5760, rate=48_000):
    return [sum(a * math.sin(2 * math.pi * hz * i / rate) for hz, a in parts) for i in range(n)]


def test_bandwidth(spark):
    takes = {1: tone([(3000, 0.2), (10_000, 0.1)]), 2: tone([(3000, 0.2)]), 3: tone([(3000, 0.2)], n=128), 4: [1e-6] * 4096}
    rows = [(s, i, [float(v) for v in x[i * 64:(i + 1) * 64]]) for s, x in takes.items() for i in range(len(x) // 64)]
    df = spark.createDataFrame(rows, "session_id long, seq long, samples array<float>")
    out = {r.session_id: (r.conclusive, r.passed) for r in timeline.bandwidth_verdict(df, 48_000, 16).collect()}
    assert out == {1: (True, True), 2: (True, False), 3: (False, True), 4: (False, True)}


def test_newest_samples_skips_non_finite(spark):
    rows = [(1, i, [float(i), float("nan")]) for i in range(10)]
    df = spark.createDataFrame(rows, "session_id long, seq long, samples array<float>")
    got = timeline.newest_samples(df.selectExpr("session_id", "seq", "samples"), 3, limit=4).first().samples
    assert [round(x, 1) for x in got] == [1.0, 1.0, 1.0, 1.0]  # clamped values of blocks 6 to 9


def test_points_in_takes(spark):
    r = random.Random(2)
    takes = [(r.randint(1, 2), s, None if r.random() < 0.02 else s + r.randint(1, 40)) for s in (r.randint(0, 900) for _ in range(60))]
    points = [(s, p) for s in (1, 2) for p in range(0, 1000, 3)]
    t = spark.createDataFrame(takes, "session_id long, start_sample long, end_sample long")
    p = spark.createDataFrame(points, "session_id long, sample long")
    for width in (10, 10_000):
        got = {(x.session_id, x.sample): x.in_take for x in timeline.points_in_takes(p, t, width).collect()}
        assert got == {(s, q): any(a == s and b <= q and (e is None or q < e) for a, b, e in takes) for s, q in points}


def test_take_coverage(spark):
    seg = spark.createDataFrame([(1, 0, 0, 100), (1, 1, 100, 100), (1, 2, 200, 30)], "session_id long, segment_index long, global_start_frame long, frames long")
    takes = spark.createDataFrame([(1, "a", 90, 130), (1, "b", 220, 240), (1, "c", 5, 5)], "session_id long, attempt_id string, start_sample long, end_sample long")
    got = {r.attempt_id: (r.parts, r.mapped_frames, r.error) for r in timeline.take_coverage(takes, seg, 100, ["attempt_id"]).collect()}
    assert got == {"a": (2, 40, None), "b": (1, 10, "not_covered"), "c": (0, 0, "empty_range")}
