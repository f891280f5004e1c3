"""Telemetry windows and summaries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.operators import telemetry as op
from reelspark.session import chunk_width

C = F.col

LAGGED = """
  p AS (SELECT *, lag(captured_samples) OVER w AS pc, lag(committed_samples) OVER w AS pm, lag(segment_total_bytes) OVER w AS pb,
               (faulted OR overflow_samples > 0 OR fault_marker_exists) AS is_fault, row_number() OVER w AS rn
        FROM telemetry WINDOW w AS (PARTITION BY session_id ORDER BY seq))"""
STALLS = LAGGED + """,
  g AS (SELECT *, CASE WHEN rn = 1 THEN segment_total_bytes > 0 ELSE segment_total_bytes > pb END AS grew FROM p),
  h AS (SELECT *, last_value(CASE WHEN grew THEN elapsed_seconds END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS lg FROM g),
  s AS (SELECT *, CASE WHEN rn > 1 AND captured_samples > pc THEN elapsed_seconds - lg END AS stall FROM h)"""
DBFS = "CASE WHEN {x} > 0 THEN greatest(-96.0::DOUBLE, 20 * log10({x})) ELSE -96.0::DOUBLE END"
SUMMARY = STALLS + f""",
  summary AS (SELECT session_id, count(*) AS sample_count,
     bool_and(rn = 1 OR captured_samples >= pc) AS captured_monotonic, bool_and(rn = 1 OR committed_samples >= pm) AS committed_monotonic,
     bool_and(rn = 1 OR segment_total_bytes >= pb) AS file_bytes_monotonic,
     coalesce(max(stall), 0.0::DOUBLE) AS max_file_growth_stall_seconds,
     max(greatest(0, captured_samples - committed_samples))::BIGINT AS max_commit_lag_samples,
     max(peak) AS maximum_peak, max(rms) AS maximum_rms,
     min(CASE WHEN is_fault THEN seq END) AS first_fault_seq, min(CASE WHEN storage_status = 'critical' THEN seq END) AS first_critical_seq,
     10.0::DOUBLE AS allowed_file_growth_stall_seconds,
     max(greatest(0, captured_samples - committed_samples)) / 48000.0::DOUBLE AS max_commit_lag_seconds,
     CASE WHEN arg_max(elapsed_seconds, seq) - arg_min(elapsed_seconds, seq) > 0 THEN
        (arg_max(captured_samples, seq) - arg_min(captured_samples, seq)) / (arg_max(elapsed_seconds, seq) - arg_min(elapsed_seconds, seq)) END AS observed_capture_rate,
     {DBFS.format(x='max(peak)')} AS maximum_peak_dbfs, {DBFS.format(x='max(rms)')} AS maximum_rms_dbfs
   FROM s GROUP BY session_id)"""


def summary(spark, sf):
    return op.progress_summary(b.telemetry(spark, sf), 48000, 1.0, chunk_width(spark))


@query("a2_progress_summary", b.with_tables("telemetry", SUMMARY + """
  SELECT * REPLACE (round(max_file_growth_stall_seconds, 6) AS max_file_growth_stall_seconds, round(observed_capture_rate, 6) AS observed_capture_rate,
                    round(maximum_peak_dbfs, 6) AS maximum_peak_dbfs, round(maximum_rms_dbfs, 6) AS maximum_rms_dbfs,
                    round(max_commit_lag_seconds, 6) AS max_commit_lag_seconds) FROM summary"""))
def a2(spark, sf):
    s = summary(spark, sf)
    for c in ("max_file_growth_stall_seconds", "observed_capture_rate", "maximum_peak_dbfs", "maximum_rms_dbfs", "max_commit_lag_seconds"):
        s = s.withColumn(c, F.round(c, 6))
    return s


@query("w2_monotonic", b.with_tables("telemetry", LAGGED + """
  SELECT session_id, bool_and(rn = 1 OR captured_samples >= pc) AS captured_monotonic, bool_and(rn = 1 OR committed_samples >= pm) AS committed_monotonic,
         bool_and(rn = 1 OR segment_total_bytes >= pb) AS file_bytes_monotonic FROM p GROUP BY 1"""))
def w2(spark, sf):
    return op.monotonic(b.telemetry(spark, sf), chunk_width(spark))


@query("w14_growth_stall", b.with_tables("telemetry", STALLS + """
  SELECT session_id, seq, round(stall, 6) AS stall_seconds FROM s"""))
def w14(spark, sf):
    return op.growth_stalls(b.telemetry(spark, sf), chunk_width(spark)).select("session_id", "seq", F.round("stall_seconds", 6).alias("stall_seconds"))


@query("a11_observed_values", b.with_tables("telemetry", """
  SELECT DISTINCT session_id, fault_kind AS observed FROM telemetry WHERE fault_kind IS NOT NULL"""))
def a11(spark, sf):
    return op.observed_values(b.telemetry(spark, sf), "fault_kind")


@query("w13_timeline_watermark", b.with_tables("telemetry", """
  SELECT session_id, seq, max(CASE WHEN k % 10 = 9 THEN committed_samples ELSE captured_samples END) OVER (PARTITION BY session_id ORDER BY seq) AS timeline FROM telemetry"""))
def w13(spark, sf):
    t = b.telemetry(spark, sf).withColumn("cursor", F.when(C("k") % 10 != 9, C("captured_samples")))
    return op.timeline_watermark(t, chunk_width(spark), "cursor", "committed_samples").select("session_id", "seq", "timeline")


FIRST_FAULT = LAGGED + """,
  ff AS (SELECT session_id, min(seq) AS first_fault_seq, arg_min(elapsed_seconds, seq) AS fault_elapsed,
                coalesce(min(CASE WHEN trim(coalesce(fault_kind, '')) <> '' THEN seq END), min(seq)) AS first_kind_seq
         FROM p WHERE is_fault GROUP BY 1)"""


@query("w15_first_fault", b.with_tables("telemetry", FIRST_FAULT + """
  SELECT ff.session_id, first_fault_seq, first_kind_seq, fault_kind AS first_kind FROM ff JOIN telemetry t ON t.seq = ff.first_kind_seq"""))
def w15(spark, sf):
    return op.first_fault(b.telemetry(spark, sf)).select(
        "session_id", C("first_fault.seq").alias("first_fault_seq"), C("first_kind.seq").alias("first_kind_seq"), C("first_kind.fault_kind").alias("first_kind"))


@query("w16_stopped_after_fault", b.with_tables("telemetry", FIRST_FAULT + """,
  a AS (SELECT p.session_id, p.captured_samples, row_number() OVER (PARTITION BY p.session_id ORDER BY p.seq DESC) AS r
        FROM p JOIN ff USING (session_id) WHERE elapsed_seconds >= fault_elapsed)
  SELECT session_id, count(*) AS tail_rows, count(DISTINCT captured_samples) AS tail_values, count(*) >= 2 AND count(DISTINCT captured_samples) = 1 AS stopped
  FROM a WHERE r <= 3 GROUP BY 1"""))
def w16(spark, sf):
    return op.stopped_after_fault(b.telemetry(spark, sf))


@query("w22_telemetry_rate", b.with_tables("telemetry", """
  x AS (SELECT session_id, phase, count(*) AS n, arg_max(captured_samples, seq) - arg_min(captured_samples, seq) AS dc, arg_max(elapsed_seconds, seq) - arg_min(elapsed_seconds, seq) AS de FROM telemetry GROUP BY ALL)
  SELECT session_id, phase, n, round(CASE WHEN de > 0 THEN dc / de END, 6) AS observed_rate, coalesce(de > 0 AND dc / de BETWEEN 48000 * 0.95 AND 48000 * 1.05, false) AS within FROM x"""))
def w22(spark, sf):
    return op.telemetry_rate(b.telemetry(spark, sf), 48000).withColumn("observed_rate", F.round("observed_rate", 6))


TRIGGER, REQUIRED, MAX_LAG = 400_000_000, 3600 * 48000, 720_000


@query("w23_armed_row", b.with_tables("telemetry", LAGGED + f"""
  SELECT session_id, min(seq) AS seq, arg_min(captured_samples, seq) AS captured_samples, arg_min(committed_samples, seq) AS committed_samples FROM p
  WHERE at_ms >= {TRIGGER} AND NOT is_fault AND committed_samples >= {REQUIRED} AND captured_samples - committed_samples BETWEEN 0 AND {MAX_LAG}
    AND committed_samples > pm AND segment_total_bytes > pb GROUP BY 1"""))
def w23(spark, sf):
    return op.armed_row(b.telemetry(spark, sf), chunk_width(spark), TRIGGER, REQUIRED, MAX_LAG).select("session_id", "armed.*")


@query("a15_meter_window", b.with_tables("telemetry", """
  SELECT session_id, at_ms // 86400000 AS slice, max(peak) AS peak, max(rms) AS rms, arg_max(captured_samples, seq) AS captured_samples, arg_max(storage_status, seq) AS storage_status
  FROM telemetry GROUP BY ALL"""))
def a15(spark, sf):
    return op.meter_window(b.telemetry(spark, sf), 86_400_000)


@query("p14_fault_row", b.with_tables("telemetry", """
  SELECT session_id, seq, (faulted OR overflow_samples > 0 OR fault_marker_exists) AS is_fault FROM telemetry"""))
def p14(spark, sf):
    return b.telemetry(spark, sf).select("session_id", "seq", op.fault_row().alias("is_fault"))


# Meter clock squeezed so that consecutive polls of a session fall within 50 ms at times.
STREAK_INPUT = "SELECT session_id, seq, k AS count, (seq * 7 % 5000)::BIGINT AS silence_samples, at_ms // 100000 AS now_ms FROM telemetry"


def streak_input(spark, sf):
    return b.telemetry(spark, sf).select("session_id", "seq", C("k").cast("long").alias("count"),
                                         (C("seq") * 7 % 5000).alias("silence_samples"), F.floor(C("at_ms") / 100000).cast("long").alias("now_ms"))


W11_SQL = b.with_tables("telemetry", f"""
  d AS ({STREAK_INPUT}),
  l AS (SELECT *, lag(count) OVER w AS pc, lag(silence_samples) OVER w AS ps FROM d WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
  i AS (SELECT *, coalesce(count > pc AND count > 0, false) AS inc, coalesce(count < pc, false) AS dec, greatest(0, silence_samples - ps) AS added FROM l),
  t AS (SELECT *, last_value(CASE WHEN inc THEN now_ms END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS li FROM i),
  f AS (SELECT *, inc AND NOT coalesce(li > 0 AND now_ms - li <= 50, false) AS fresh FROM t),
  n AS (SELECT *, sum(CASE WHEN fresh OR dec THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM f),
  r AS (SELECT *, sum(CASE WHEN inc THEN added ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) AS total FROM n)
  SELECT session_id, seq, total::BIGINT AS streak_silence_samples, floor(total / 48000.0::DOUBLE * 1000 + 0.5) >= 10 AS show FROM r WHERE inc""")


@query("w11_discontinuity_streak", W11_SQL)
def w11(spark, sf):
    return op.discontinuity_streaks(streak_input(spark, sf), chunk_width(spark), 48000)


def bin_input(spark, sf):
    return b.telemetry(spark, sf).select("session_id", "seq", (C("k") % 12).cast("long").alias("n_bins"),
                                         (F.floor(C("at_ms") / 600_000).cast("long") * 16 - C("k")).alias("end_sample"))


@query("w12_bin_batch_reconcile", b.with_tables("telemetry", """
  d AS (SELECT session_id, seq, (k % 12)::BIGINT AS n_bins, at_ms // 600000 * 16 - k AS end_sample FROM telemetry),
  e AS (SELECT *, end_sample - n_bins * 64 AS start_sample, n_bins > 0 AND end_sample - n_bins * 64 >= 0 AS live FROM d),
  m AS (SELECT *, max(CASE WHEN live THEN end_sample END) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM e),
  n AS (SELECT *, NOT live OR coalesce(end_sample <= pe, false) AS stale FROM m)
  SELECT session_id, seq, n_bins, start_sample, end_sample,
         CASE WHEN stale THEN 0 ELSE n_bins - coalesce(least(n_bins, ceil(greatest(0, pe - start_sample) / 64.0::DOUBLE)::BIGINT), 0) END AS kept_bins,
         NOT stale AND coalesce(start_sample > pe, false) AS reset,
         coalesce(greatest(pe, CASE WHEN live THEN end_sample END), 0) AS timeline_end FROM n"""))
def w12(spark, sf):
    return op.bin_batches(bin_input(spark, sf), chunk_width(spark))


@query("w17_take_spans", b.with_tables("telemetry", """
  r AS (SELECT session_id, seq, captured_samples AS cursor, k < 60 AS recording, coalesce(lag(k < 60) OVER (PARTITION BY session_id ORDER BY seq), false) AS was FROM telemetry),
  e AS (SELECT *, sum(CASE WHEN recording AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS span FROM r)
  SELECT session_id, span::BIGINT AS span, min(CASE WHEN recording AND NOT was THEN cursor END) AS start_sample,
         CASE WHEN bool_or(was AND NOT recording) THEN greatest(min(CASE WHEN recording AND NOT was THEN cursor END), max(CASE WHEN was AND NOT recording THEN cursor END)) END AS end_sample
  FROM e WHERE recording <> was GROUP BY ALL"""))
def w17(spark, sf):
    t = b.telemetry(spark, sf).select("session_id", "seq", C("captured_samples").alias("cursor"), (C("k") < 60).alias("recording"))
    return op.take_spans(t, chunk_width(spark))


@query("w19_consecutive_matches", b.with_tables("telemetry", """
  m AS (SELECT session_id, seq, value < 60 AS matched, sum(CASE WHEN value < 60 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM telemetry)
  SELECT session_id, seq, matched, (CASE WHEN matched THEN sum(CASE WHEN matched THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, island ORDER BY seq ROWS UNBOUNDED PRECEDING) ELSE 0 END)::BIGINT AS matches FROM m"""))
def w19(spark, sf):
    return op.consecutive(b.telemetry(spark, sf), chunk_width(spark), C("value") < 60).select("session_id", "seq", "matched", "matches")
