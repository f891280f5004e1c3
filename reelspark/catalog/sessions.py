"""Snapshots, history, items, takes and deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.operators import rules, sessions as op
from reelspark.plans import history as plan
from reelspark.session import chunk_width
from reelspark.sources import snapshots as src

C = F.col

LATEST = """
  ids AS (SELECT session_dir, min(session_id) AS lo, max(session_id) AS hi FROM candidates GROUP BY 1),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY session_dir ORDER BY journal_seq DESC, priority DESC, ordinal DESC) AS rn FROM candidates),
  latest AS (SELECT r.* EXCLUDE (rn) FROM ranked r JOIN ids USING (session_dir) WHERE rn = 1 AND lo = hi)"""
COUNTS = """
  counts AS (SELECT session_id, count(*) AS total_items, count_if(status = 'accepted')::BIGINT AS accepted_items, count_if(status = 'skipped')::BIGINT AS skipped_items,
                    count_if(status = 'review')::BIGINT AS review_items, count_if(status = 'pending')::BIGINT AS pending_items FROM items GROUP BY 1)"""
OVERRIDE = LATEST + """,
  mk AS (SELECT session_dir, max(modified_at) AS mm FROM markers GROUP BY 1),
  marked AS (SELECT l.* REPLACE (CASE WHEN mm IS NOT NULL THEN 'faulted' ELSE l.status END AS status, CASE WHEN mm > l.modified_at THEN mm ELSE l.modified_at END AS modified_at), mm IS NOT NULL AS fault_marker
             FROM latest l LEFT JOIN mk USING (session_dir))"""


@query("w1_latest_snapshot", b.with_tables("candidates", LATEST + """
  SELECT session_dir, session_id, journal_seq, priority::INTEGER AS priority, ordinal, modified_at, status, overflow_samples, committed_samples, captured_samples FROM latest"""))
def w1(spark, sf):
    return op.latest_snapshot(b.candidates(spark, sf))


@query("a9_identity_conflict", b.with_tables("candidates", """
  SELECT session_dir, CASE WHEN min(session_id) = max(session_id) THEN min(session_id) END AS trusted_id, count(DISTINCT session_id) > 1 AS conflict FROM candidates GROUP BY 1"""))
def a9(spark, sf):
    return op.identity(b.candidates(spark, sf))


@query("a9_conflicting_ids", b.with_tables("candidates", """
  SELECT DISTINCT session_dir, session_id FROM candidates WHERE session_dir IN (SELECT session_dir FROM candidates GROUP BY 1 HAVING count(DISTINCT session_id) > 1)"""))
def a9_ids(spark, sf):
    return op.conflicting_ids(b.candidates(spark, sf))


@query("p6_fault_override", b.with_tables("candidates markers", OVERRIDE + """
  SELECT session_dir, status, modified_at, fault_marker FROM marked"""))
def p6(spark, sf):
    return op.fault_override(op.latest_snapshot(b.candidates(spark, sf)), b.markers(spark, sf)).select("session_dir", "status", "modified_at", "fault_marker")


@query("t6_newest_evidence", b.with_tables("markers", "SELECT session_dir, max(modified_at) AS marker_modified_at FROM markers GROUP BY 1"))
def t6(spark, sf):
    return op.newest_evidence(b.markers(spark, sf))


@query("a1_item_counts", b.with_tables("items", COUNTS + " SELECT * FROM counts"))
def a1(spark, sf):
    return op.item_counts(b.items(spark, sf))


KIND = """CASE WHEN status = 'faulted' OR overflow_samples > 0 THEN 'attention' WHEN status IN ('recording', 'stopping') THEN 'attention'
  WHEN pending_items + review_items > 0 THEN 'unfinished' ELSE 'completed' END"""
PAGE = OVERRIDE + "," + COUNTS + f""",
  dirs AS (SELECT session_dir, max(modified_at) AS m FROM candidates GROUP BY 1 ORDER BY m DESC, session_dir LIMIT 100 OFFSET 20),
  pg AS (SELECT d.session_dir, coalesce(m.session_id, d.session_dir::VARCHAR) AS session_id, m.session_id IS NULL AS history_issue, coalesce(m.status, 'invalid') AS status,
                coalesce(m.modified_at, d.m) AS modified_at, m.journal_seq, m.fault_marker, coalesce(m.captured_samples, 0)::BIGINT AS captured_samples, coalesce(m.committed_samples, 0)::BIGINT AS committed_samples,
                coalesce(m.overflow_samples, 0)::BIGINT AS overflow_samples, CASE WHEN m.session_id IS NULL THEN 0 ELSE coalesce(total_items, 0) END AS total_items,
                CASE WHEN m.session_id IS NULL THEN 0 ELSE coalesce(accepted_items, 0) END AS accepted_items, CASE WHEN m.session_id IS NULL THEN 0 ELSE coalesce(skipped_items, 0) END AS skipped_items,
                CASE WHEN m.session_id IS NULL THEN 0 ELSE coalesce(review_items, 0) END AS review_items, CASE WHEN m.session_id IS NULL THEN 0 ELSE coalesce(pending_items, 0) END AS pending_items
         FROM dirs d LEFT JOIN marked m USING (session_dir) LEFT JOIN counts c ON c.session_id = d.session_dir)
  SELECT session_dir, session_id, status, CASE WHEN history_issue THEN 'attention' ELSE {KIND} END AS kind, history_issue,
         CASE WHEN history_issue THEN NULL WHEN fault_marker OR status IN ('faulted', 'recording', 'stopping') OR overflow_samples > 0 THEN 'needs_repair' ELSE 'normal' END AS data_health,
         journal_seq, captured_samples, committed_samples, overflow_samples, modified_at, total_items, accepted_items, skipped_items, review_items, pending_items FROM pg"""


def history_page_query(spark, sf, offset=20):
    return plan.history_page(b.candidates(spark, sf), b.markers(spark, sf), b.items(spark, sf), offset=offset)


@query("t1_history_page", b.with_tables("candidates markers items", PAGE))
def t1(spark, sf):
    return history_page_query(spark, sf)


@query("t1_page_totals", b.with_tables("candidates", """
  n AS (SELECT count(DISTINCT session_dir) AS n FROM candidates)
  SELECT n AS total_directories, greatest(0, least(n, 120) - 20) AS scanned_directories, CASE WHEN 120 < n THEN 120::BIGINT END AS next_offset FROM n"""))
def t1_totals(spark, sf):
    return plan.page_totals(b.candidates(spark, sf).select("session_dir").distinct(), 20, 100)


FULL_KIND = """CASE WHEN history_issue OR status = 'faulted' OR overflow_samples > 0 THEN 'attention' WHEN is_active AND status = 'stopping' THEN 'attention'
  WHEN is_active THEN 'unfinished' WHEN status IN ('recording', 'stopping') THEN 'attention' WHEN pending_items + review_items > 0 THEN 'unfinished' ELSE 'completed' END"""


@query("p3_session_kind", b.with_tables("history", f"SELECT session_id, {FULL_KIND} AS kind FROM history"))
def p3(spark, sf):
    return b.history(spark, sf).select("session_id", rules.session_kind().alias("kind"))


@query("p4_history_filter", b.with_tables("history", f"""
  k AS (SELECT session_id, {FULL_KIND} AS kind FROM history)
  SELECT session_id, 'completed' AS shown FROM k WHERE kind = 'completed' UNION ALL SELECT session_id, 'rest' FROM k WHERE kind <> 'completed'"""))
def p4(spark, sf):
    h = b.history(spark, sf)
    return h.where(rules.history_filter("completed")).select("session_id", F.lit("completed").alias("shown")).unionByName(
        h.where(rules.history_filter("rest")).select("session_id", F.lit("rest").alias("shown")))


@query("p5_data_health", b.with_tables("history", """
  SELECT session_id, CASE WHEN fault_marker OR status IN ('faulted', 'recording', 'stopping') OR overflow_samples > 0 THEN 'needs_repair' ELSE 'normal' END AS data_health FROM history"""))
def p5(spark, sf):
    return b.history(spark, sf).select("session_id", rules.data_health().alias("data_health"))


PLAN = """
  pl AS (SELECT *, pending_items + review_items > 0 AS open, status = 'faulted' OR overflow_samples > 0 AS bad, status IN ('recording', 'stopping') AS running FROM history),
  pn AS (SELECT *, NOT is_active AND NOT bad AND (running OR status = 'stopped') AND open AS can_resume, NOT is_active AND (bad OR running) AS can_seal FROM pl)"""


@query("p7_recovery_plan", b.with_tables("history", PLAN + """
  SELECT session_id, can_resume, can_seal, CASE WHEN can_resume THEN 'resume' WHEN can_seal THEN 'seal' END AS "primary", CASE WHEN can_resume AND can_seal THEN 'seal' END AS secondary FROM pn"""))
def p7(spark, sf):
    return b.history(spark, sf).select("session_id", rules.recovery_plan().alias("p")).select("session_id", "p.*")


@query("p8_task_entry", b.with_tables("history", PLAN + """,
  e AS (SELECT *, CASE WHEN is_active AND status = 'stopping' THEN 'continue-stop' WHEN is_active THEN 'return' WHEN history_issue OR readonly OR can_seal THEN 'view-only' ELSE 'view-record' END AS entry FROM pn)
  SELECT session_id, entry, CASE WHEN entry = 'view-only' THEN CASE WHEN history_issue THEN 'issue' WHEN readonly THEN 'readonly' ELSE 'fault' END END AS disabled_reason,
         CASE WHEN entry = 'view-record' THEN NOT open END AS view_primary FROM e"""))
def p8(spark, sf):
    return b.history(spark, sf).select("session_id", rules.task_entry().alias("p")).select("session_id", "p.*")


@query("p13_capture_fault_kind", b.with_tables("history", """
  SELECT session_id, CASE WHEN NOT is_active THEN NULL WHEN status = 'faulted' OR overflow_samples > 0 OR storage_status = 'critical' THEN 'capture'
     WHEN engine_status = 'connecting' THEN 'engine_recovering' WHEN engine_status = 'offline' THEN 'engine_offline' END AS fault_kind FROM history"""))
def p13(spark, sf):
    return b.history(spark, sf).select("session_id", rules.capture_fault_kind().alias("fault_kind"))


@query("p26_noise_gate", b.with_tables("history", """
  SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'ready' WHEN is_active THEN 'checking' WHEN session_id % 3 = 0 THEN 'pending' WHEN pending_items = 0 THEN 'ready' ELSE 'failed' END AS gate FROM history"""))
def p26(spark, sf):
    passed = F.when(C("session_id") % 3 != 0, C("pending_items") == 0)
    return b.history(spark, sf).select("session_id", rules.noise_gate(passed, C("is_active"), C("session_id") % 4 != 0).alias("gate"))


# --- items ---------------------------------------------------------------------------

@query("j4_script_left_state", b.with_tables("items", """
  SELECT c_custkey AS session_id, o_orderkey AS item_id, coalesce(i.status, 'pending') AS status FROM customer JOIN orders ON c_custkey = o_custkey
  LEFT JOIN (SELECT * FROM items WHERE item_id % 3 <> 0) i ON i.session_id = c_custkey AND i.item_id = o_orderkey"""))
def j4(spark, sf):
    script = b.table(spark, sf, "customer").join(b.table(spark, sf, "orders"), C("c_custkey") == C("o_custkey")).select(
        C("c_custkey").alias("session_id"), C("o_orderkey").alias("item_id"))
    return op.script_left_state(script, b.items(spark, sf).where("item_id % 3 <> 0"))


@query("a16_capture_exit", b.with_tables("turns", """
  f AS (SELECT DISTINCT session_id, session_id % 6 = 0 AS faulted FROM turns UNION ALL SELECT -1, false),
  d AS (SELECT session_id, bool_and(status IN ('accepted', 'skipped')) AS ok FROM turns GROUP BY 1)
  SELECT session_id, faulted, coalesce(ok, false) AS all_handled, CASE WHEN faulted THEN 'fault' WHEN coalesce(ok, false) THEN 'complete' ELSE 'pause' END AS exit FROM f LEFT JOIN d USING (session_id)"""))
def a16(spark, sf):
    t = b.turns(spark, sf)
    faults = t.select("session_id", (C("session_id") % 6 == 0).alias("faulted")).distinct()
    faults = faults.unionByName(t.agg(F.lit(-1).cast("long").alias("session_id"), F.lit(False).alias("faulted")))
    return op.capture_exit(t, faults)


@query("w7_next_actionable", b.with_tables("turns", """
  o AS (SELECT session_id, pos, status FROM turns WHERE status IN ('pending', 'review')),
  a AS (SELECT t.session_id, t.pos, coalesce((SELECT min(o.pos) FROM o WHERE o.session_id = t.session_id AND o.pos > t.pos), (SELECT min(o.pos) FROM o WHERE o.session_id = t.session_id)) AS next_pos FROM turns t),
  h AS (SELECT session_id, bool_and(status IN ('accepted', 'skipped')) AS ok FROM turns GROUP BY 1)
  SELECT a.session_id, a.pos, next_pos, CASE WHEN o.status = 'pending' THEN 'start' WHEN o.status = 'review' THEN 'review' WHEN ok THEN 'finish' ELSE 'blocked' END AS continuation
  FROM a JOIN h USING (session_id) LEFT JOIN o ON o.session_id = a.session_id AND o.pos = next_pos"""))
def w7(spark, sf):
    return op.next_actionable(b.turns(spark, sf), chunk_width(spark))


@query("w7_resume_position", b.with_tables("turns", """
  h AS (SELECT DISTINCT session_id, session_id % 9 AS a, session_id % 5 AS k FROM turns)
  SELECT t.session_id, coalesce(max(CASE WHEN pos = a THEN pos END), max(CASE WHEN pos = k THEN pos END), min(CASE WHEN status IN ('pending', 'review') THEN pos END), 0) AS resume_pos
  FROM turns t JOIN h USING (session_id) GROUP BY 1"""))
def w7_resume(spark, sf):
    t = b.turns(spark, sf)
    hints = t.select("session_id", (C("session_id") % 9).alias("active_pos"), (C("session_id") % 5).alias("keep_pos")).distinct()
    return op.resume_position(t, hints)


@query("w21_final_review", b.with_tables("turns", """
  SELECT t.session_id, pos FROM turns t WHERE status = 'review' AND NOT EXISTS (SELECT 1 FROM turns o WHERE o.session_id = t.session_id AND o.pos <> t.pos AND o.status NOT IN ('accepted', 'skipped'))"""))
def w21(spark, sf):
    return op.final_review(b.turns(spark, sf))


# --- takes ---------------------------------------------------------------------------

@query("p2_usable_take", b.with_tables("takes", """
  SELECT item_id, attempt_id, start_sample, end_sample FROM takes WHERE status NOT IN ('interrupted', 'needs_rerecord') AND end_sample > start_sample"""))
def p2(spark, sf):
    from reelspark.functions import samples
    return b.takes(spark, sf).where(samples.usable_take(C("status"), C("start_sample"), C("end_sample"))).select("item_id", "attempt_id", "start_sample", "end_sample")


CHOSEN = """
  u AS (SELECT *, status NOT IN ('interrupted', 'needs_rerecord') AND end_sample > start_sample AS usable FROM takes),
  sel AS (SELECT u.*, row_number() OVER (PARTITION BY u.item_id ORDER BY pos) AS r FROM u JOIN items i ON u.item_id = i.item_id AND u.attempt_id = i.selected_attempt_id),
  s1 AS (SELECT * FROM sel WHERE r = 1 AND usable),
  lat AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos DESC) AS r FROM u WHERE usable),
  chosen AS (SELECT * FROM s1 UNION ALL SELECT * FROM lat WHERE r = 1 AND item_id NOT IN (SELECT item_id FROM s1))"""
MARKS = CHOSEN + """,
  hs AS (SELECT c.* EXCLUDE (item_id), i.item_id, i.session_id AS owner, CASE WHEN head_silence_passed_sample > 0 AND head_silence_passed_sample >= 24000 THEN greatest(coalesce(nullif(recording_started_sample, 0), start_sample), head_silence_passed_sample - 24000)
                          ELSE coalesce(nullif(recording_started_sample, 0), start_sample) END AS hstart FROM items i LEFT JOIN chosen c USING (item_id) WHERE i.status IN ('review', 'accepted')),
  ms AS (SELECT *, CASE WHEN content_started_sample > 0 THEN floor(greatest(0, content_started_sample - hstart) / 48000 * 1000 + 0.5)::BIGINT END AS head_ms,
                CASE WHEN tail_silence_samples IS NOT NULL THEN floor(tail_silence_samples / 48000 * 1000 + 0.5)::BIGINT END AS tail_ms FROM hs),
  marks AS (SELECT item_id, owner AS session_id, head_ms, tail_ms, coalesce(head_ms < 600, false) AS head_short, coalesce(forced_without_tail_silence, false) OR coalesce(tail_ms < 600, false) AS tail_short FROM ms)"""


def chosen(spark, sf):
    return op.chosen_take(b.takes(spark, sf).drop("session_id"), b.items(spark, sf))


@query("j3_selected_or_latest_take", b.with_tables("takes items", CHOSEN + " SELECT item_id, attempt_id, start_sample, end_sample, peak FROM chosen"))
def j3(spark, sf):
    return chosen(spark, sf).select("item_id", "take.attempt_id", "take.start_sample", "take.end_sample", "take.peak")


@query("f9_item_silence_marks", b.with_tables("takes items", MARKS + " SELECT * FROM marks"))
def f9(spark, sf):
    return op.silence_marks(chosen(spark, sf), b.items(spark, sf), 48000, 600)


@query("a14_flagged_takes", b.with_tables("takes items", MARKS + " SELECT session_id, count_if(head_short OR tail_short)::BIGINT AS flagged_items FROM marks GROUP BY 1"))
def a14(spark, sf):
    return op.flagged_takes(op.silence_marks(chosen(spark, sf), b.items(spark, sf), 48000, 600))


@query("j13_before_after_reconcile", """
  WITH t AS (SELECT conv_id AS session_id, 'a' || turn AS attempt_id, turn, md5(text) AS fp, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
  bf AS (SELECT session_id, attempt_id, fp, 10 AS seq FROM t WHERE turn < n - session_id % 3),
  af AS (SELECT session_id, attempt_id, CASE WHEN session_id % 7 = 0 AND turn = 1 THEN 'edited' ELSE fp END AS fp, CASE WHEN session_id % 5 = 0 THEN 13 ELSE 11 END AS seq FROM t WHERE NOT (session_id % 11 = 0 AND turn = 0)),
  j AS (SELECT coalesce(bf.session_id, af.session_id) AS session_id, bf.fp AS was, af.fp AS now, bf.seq AS sb, af.seq AS sa FROM bf FULL JOIN af ON bf.session_id = af.session_id AND bf.attempt_id = af.attempt_id),
  g AS (SELECT session_id, max(sb) AS sb, max(sa) AS sa, count_if(was IS NULL)::BIGINT AS added, count_if(now IS NULL)::BIGINT AS removed, coalesce(count_if(was <> now), 0)::BIGINT AS changed FROM j GROUP BY 1)
  SELECT session_id, added, removed, changed, CASE WHEN sa = sb + 1 AND removed = 0 AND changed = 0 AND added = 1 THEN 'take_added' WHEN sa = sb + 1 AND removed = 0 AND changed = 0 AND added = 0 THEN 'discarded' ELSE 'unproven' END AS outcome FROM g""")
def j13(spark, sf):
    c = b.table(spark, sf, "conversations")
    n = c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    t = c.join(n, "conv_id").select(C("conv_id").alias("session_id"), F.concat(F.lit("a"), C("turn").cast("string")).alias("attempt_id"), "turn", "n",
                                    F.md5("text").alias("fingerprint"))
    s = C("session_id")
    before = t.where(C("turn") < C("n") - s % 3).withColumn("journal_seq", F.lit(10))
    after = t.where(~((s % 11 == 0) & (C("turn") == 0))).withColumn("fingerprint", F.when((s % 7 == 0) & (C("turn") == 1), "edited").otherwise(C("fingerprint")))
    after = after.withColumn("journal_seq", F.when(s % 5 == 0, 13).otherwise(11))
    return op.reconcile(before, after, ["session_id"])


@query("j16_interrupted_takes", b.with_tables("telemetry", """
  st AS (SELECT session_id, 'a' || (k % 20) AS attempt_id, seq, captured_samples AS start_sample FROM telemetry WHERE phase = 'signup'),
  sp AS (SELECT session_id, 'a' || (k % 20) AS attempt_id, seq FROM telemetry WHERE phase = 'purchase'),
  du AS (SELECT session_id, CASE WHEN session_id % 4 = 0 THEN 'stopped' ELSE 'recording' END AS status, max(seq) AS journal_seq, max(committed_samples) AS physical_frames FROM telemetry GROUP BY 1)
  SELECT st.session_id, attempt_id, start_sample, physical_frames AS end_sample, 'interrupted' AS take_status, 'stopped' AS session_status, physical_frames AS captured_samples, journal_seq + 1 AS journal_seq
  FROM st JOIN du USING (session_id) WHERE du.status <> 'stopped' AND NOT EXISTS (SELECT 1 FROM sp WHERE sp.session_id = st.session_id AND sp.attempt_id = st.attempt_id AND sp.seq > st.seq)"""))
def j16(spark, sf):
    t = b.telemetry(spark, sf).withColumn("attempt_id", F.concat(F.lit("a"), (C("k") % 20).cast("string")))
    started = t.where("phase = 'signup'").select("session_id", "attempt_id", "seq", C("captured_samples").alias("start_sample"))
    stopped = t.where("phase = 'purchase'").select("session_id", "attempt_id", "seq")
    durable = t.groupBy("session_id").agg(F.max("seq").alias("journal_seq"), F.max("committed_samples").alias("physical_frames")).withColumn(
        "status", F.when(C("session_id") % 4 == 0, "stopped").otherwise("recording"))
    return op.interrupted_takes(started, stopped, durable)


# --- deliveries: documents of every session's artifacts, derived from its state ----------

DELIVERY = LATEST + """,
  snap AS (SELECT session_dir AS session_id, journal_seq, committed_samples, status, overflow_samples, 'p' || (session_dir % 4) AS provenance, session_dir % 10 = 0 AS fault_marker FROM latest),
  docs AS (SELECT session_id, a AS artifact, session_id % 13 <> 0 AS readable, CASE WHEN session_id % 17 = 0 THEN 1 ELSE 2 END AS schema_version, session_id AS doc_session_id,
                  a AS doc_artifact, CASE WHEN session_id % 19 = 0 THEN 'running' ELSE 'complete' END AS doc_status, journal_seq - CASE WHEN session_id % 5 = 0 THEN 1 ELSE 0 END AS source_seq,
                  committed_samples AS source_committed, CASE WHEN session_id % 6 = 0 THEN 'p9' ELSE provenance END AS source_provenance, session_id % 23 <> 0 AS output_exists
           FROM snap, (VALUES ('full_track'), ('sentences'), ('metadata_json'), ('metadata_csv')) v(a) WHERE (session_id + length(a)) % 8 <> 0),
  sl AS (SELECT session_id, item_id, item_id AS pos, selected_attempt_id AS attempt_id FROM items),
  ds AS (SELECT session_id, item_id, item_id AS pos, CASE WHEN item_id % 41 = 0 THEN NULL ELSE selected_attempt_id END AS attempt_id FROM items WHERE item_id % 151 <> 0),
  eq AS (SELECT coalesce(sl.session_id, ds.session_id) AS session_id, bool_and(sl.item_id IS NOT NULL AND ds.item_id IS NOT NULL AND sl.attempt_id IS NOT DISTINCT FROM ds.attempt_id) AS selections_equal
         FROM sl FULL JOIN ds ON sl.session_id = ds.session_id AND sl.pos = ds.pos GROUP BY 1)"""
ARTIFACTS = ("full_track", "sentences", "metadata_json", "metadata_csv")


def delivery_inputs(spark, sf):
    s = C("session_id")
    snap = op.latest_snapshot(b.candidates(spark, sf)).select(
        C("session_dir").alias("session_id"), "journal_seq", "committed_samples", "status", "overflow_samples",
        F.concat(F.lit("p"), (C("session_dir") % 4).cast("string")).alias("provenance"), (C("session_dir") % 10 == 0).alias("fault_marker"))
    docs = snap.select("*", F.explode(F.array(*[F.lit(a) for a in ARTIFACTS])).alias("artifact")).where((s + F.length("artifact")) % 8 != 0)
    docs = docs.select(
        "session_id", "artifact", (s % 13 != 0).alias("readable"), F.when(s % 17 == 0, 1).otherwise(2).alias("schema_version"), s.alias("doc_session_id"),
        C("artifact").alias("doc_artifact"), F.when(s % 19 == 0, "running").otherwise("complete").alias("doc_status"),
        (C("journal_seq") - F.when(s % 5 == 0, 1).otherwise(0)).alias("source_seq"), C("committed_samples").alias("source_committed"),
        F.when(s % 6 == 0, "p9").otherwise(C("provenance")).alias("source_provenance"), (s % 23 != 0).alias("output_exists"))
    i = b.items(spark, sf).withColumn("pos", C("item_id")).withColumnRenamed("selected_attempt_id", "attempt_id")
    doc_sel = i.where("item_id % 151 <> 0").withColumn("attempt_id", F.when(C("item_id") % 41 != 0, C("attempt_id")))
    return snap, docs, op.selections_equal(i, doc_sel)


STATE_SQL = """CASE WHEN d.readable IS NULL THEN 'never' WHEN NOT readable OR schema_version <> 2 OR doc_status <> 'complete' OR NOT output_exists THEN 'failed'
  WHEN artifact = 'full_track' THEN CASE WHEN source_committed = committed_samples AND source_provenance = provenance THEN 'current' ELSE 'stale' END
  WHEN source_committed = committed_samples AND source_seq = journal_seq AND coalesce(selections_equal, true) THEN 'current' ELSE 'stale' END"""


@query("j11_export_state", b.with_tables("candidates items", DELIVERY + f"""
  SELECT snap.session_id, artifact, {STATE_SQL} AS state FROM snap LEFT JOIN docs d USING (session_id) LEFT JOIN eq ON eq.session_id = snap.session_id"""))
def j11(spark, sf):
    snap, docs, eq = delivery_inputs(spark, sf)
    return op.export_state(snap, docs, eq).select("session_id", "artifact", "state")


@query("p25_complete_export", b.with_tables("candidates items", DELIVERY + """
  SELECT snap.session_id FROM snap LEFT JOIN eq ON eq.session_id = snap.session_id WHERE status = 'stopped' AND NOT fault_marker AND overflow_samples = 0 AND snap.session_id % 19 <> 0
    AND snap.session_id % 17 <> 0 AND snap.session_id % 5 <> 0 AND coalesce(selections_equal, true)
    AND (SELECT count(*) FROM (VALUES ('full-track.wav'), ('metadata.json'), ('metadata.csv'), ('sentences')) v(n) WHERE (snap.session_id + length(n)) % 8 = 0) = 0"""))
def p25(spark, sf):
    snap, _, eq = delivery_inputs(spark, sf)
    s = C("session_id")
    outputs = ("full-track.wav", "metadata.json", "metadata.csv", "sentences")
    files = snap.select("session_id", F.explode(F.array(*[F.lit(o) for o in outputs])).alias("name")).where((s + F.length("name")) % 8 != 0)
    bundles = snap.select(
        "session_id", F.when(s % 17 == 0, 1).otherwise(2).alias("bundle_version"), F.when(s % 19 == 0, "running").otherwise("complete").alias("bundle_status"),
        F.lit("e1").alias("export_id"), s.alias("bundle_session_id"), (C("journal_seq") - F.when(s % 5 == 0, 1).otherwise(0)).alias("source_seq"),
        C("committed_samples").alias("source_committed"))
    return op.complete_export(snap, bundles, files, outputs, eq)


# --- documents: journal lines with damage, one per event -----------------------------------

HEAD = '{"schema_version":'
JOURNAL_SQL = """
  jl AS (SELECT session_id AS session_dir, seq AS line_no, k, phase, at_ms AS modified_at,
    '{"journal_seq":' || seq || ',"event":"' || CASE WHEN k = 51 THEN '' ELSE phase END || '","at":"x","payload":{},"snapshot":{"schema_version":' || CASE WHEN k = 54 THEN '2' ELSE '1' END
    || ',"session_id":"s' || session_id || '","journal_seq":' || CASE WHEN k = 52 THEN '"' || seq || '"' WHEN k = 50 THEN (seq + 1)::VARCHAR ELSE seq::VARCHAR END
    || ',"status":"recording","device_name":"mic","audio_format":{"sample_rate":48000,"channels":1,"input_channels":2},"master_audio":"audio","captured_samples":' || captured_samples
    || ',"committed_samples":' || CASE WHEN k = 53 THEN '-1' ELSE committed_samples::VARCHAR END || ',"overflow_samples":0,"started_at":"a","updated_at":"b","items":[{"id":"i","text":"t","label":"","status":"pending","attempts":['
    || CASE WHEN k = 55 THEN '{"attempt_id":"a","start_sample":1.5,"end_sample":2,"status":"accepted","created_at":"c"}' WHEN k = 56 THEN '{"attempt_id":"a","start_sample":1,"end_sample":2,"status":"accepted","created_at":"c"}' ELSE '' END || ']}]'
    || CASE WHEN k = 57 THEN ',"capture_share_mode":"both"' WHEN k = 58 THEN ',"noise_check":null' WHEN k = 59 THEN ',"segment_frames":1' ELSE '' END
    || '}' || CASE WHEN k % 10 = 9 AND k < 50 THEN '' ELSE '}' END AS text FROM telemetry)"""
JOURNAL_OK = "(NOT (k % 10 = 9 AND k < 50)) AND k NOT IN (51, 54, 52, 50, 53, 55, 57, 59) AND line_no > 0"


def journal_lines(spark, sf):
    t = b.telemetry(spark, sf)
    k = C("k")
    s = lambda c: c.cast("string")
    attempt = '{{"attempt_id":"a","start_sample":{0},"end_sample":2,"status":"accepted","created_at":"c"}}'
    text = F.concat(
        F.lit('{"journal_seq":'), s(C("seq")), F.lit(',"event":"'), F.when(k == 51, "").otherwise(C("phase")), F.lit('","at":"x","payload":{},"snapshot":{"schema_version":'),
        F.when(k == 54, "2").otherwise("1"), F.lit(',"session_id":"s'), s(C("session_id")), F.lit('","journal_seq":'),
        F.when(k == 52, F.concat(F.lit('"'), s(C("seq")), F.lit('"'))).when(k == 50, s(C("seq") + 1)).otherwise(s(C("seq"))),
        F.lit(',"status":"recording","device_name":"mic","audio_format":{"sample_rate":48000,"channels":1,"input_channels":2},"master_audio":"audio","captured_samples":'),
        s(C("captured_samples")), F.lit(',"committed_samples":'), F.when(k == 53, "-1").otherwise(s(C("committed_samples"))),
        F.lit(',"overflow_samples":0,"started_at":"a","updated_at":"b","items":[{"id":"i","text":"t","label":"","status":"pending","attempts":['),
        F.when(k == 55, attempt.format("1.5")).when(k == 56, attempt.format("1")).otherwise(""), F.lit("]}]"),
        F.when(k == 57, ',"capture_share_mode":"both"').when(k == 58, ',"noise_check":null').when(k == 59, ',"segment_frames":1').otherwise(""),
        F.lit("}"), F.when((k % 10 == 9) & (k < 50), "").otherwise("}"))
    return t.select(C("session_id").alias("session_dir"), C("seq").alias("line_no"), "k", C("at_ms").alias("modified_at"), text.alias("text"))


@query("s6_journal_read", b.with_tables("telemetry", JOURNAL_SQL + f"""
  SELECT session_dir, line_no + 7 AS ordinal, phase AS event, line_no AS journal_seq, 40 AS priority FROM jl WHERE {JOURNAL_OK}"""))
def s6(spark, sf):
    return src.journal_events(journal_lines(spark, sf)).select("session_dir", "ordinal", "event", "journal_seq", "priority")


@query("p1_snapshot_valid", b.with_tables("telemetry", JOURNAL_SQL + """
  SELECT line_no, json_valid(text) AND k NOT IN (54, 52, 53, 55, 57, 59) AS valid FROM jl"""))
def p1(spark, sf):
    from reelspark.functions import documents as d
    return journal_lines(spark, sf).select("line_no", src.snapshot_valid(d.at(d.parse(C("text")), "$.snapshot")).alias("valid"))


GEN_CASE = "CASE k % 8 " + " ".join(f"WHEN {i} THEN {{{i}}}" for i in range(7)) + " END"


@query("s5_snapshot_generations", b.with_tables("telemetry", JOURNAL_SQL + """
  SELECT session_dir, line_no + CASE WHEN k = 50 THEN 1 ELSE 0 END AS journal_seq, CASE k % 8 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 9 WHEN 4 THEN 10 WHEN 5 THEN 9 WHEN 6 THEN 8 END AS priority,
         (k % 8)::BIGINT AS ordinal FROM jl WHERE k % 8 < 7 AND json_valid(text) AND k NOT IN (54, 52, 53, 55, 57, 59)"""))
def s5(spark, sf):
    from reelspark.functions import documents as d
    return src.snapshot_candidates(generation_files(spark, sf)).select("session_dir", "journal_seq", "priority", "ordinal")


def generation_files(spark, sf):
    from reelspark.functions import documents as d
    names = F.array(*[F.lit(n) for n, _ in src.GENERATIONS])
    return journal_lines(spark, sf).select(
        "session_dir", "modified_at", F.get(names, C("k") % 8).alias("name"),
        d.at(d.parse(C("text")), "$.snapshot").cast("string").alias("text"))


@query("u1_candidate_union", b.with_tables("telemetry", JOURNAL_SQL + f""",
  u AS (SELECT session_dir, line_no + CASE WHEN k = 50 THEN 1 ELSE 0 END AS journal_seq, CASE k % 8 WHEN 0 THEN 30 WHEN 1 THEN 20 WHEN 2 THEN 10 WHEN 3 THEN 9 WHEN 4 THEN 10 WHEN 5 THEN 9 WHEN 6 THEN 8 END AS priority, (k % 8)::BIGINT AS ordinal
        FROM jl WHERE k % 8 < 7 AND json_valid(text) AND k NOT IN (54, 52, 53, 55, 57, 59)
        UNION ALL SELECT session_dir, line_no, 40, line_no + 7 FROM jl WHERE {JOURNAL_OK})
  SELECT session_dir, journal_seq, priority, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY session_dir ORDER BY journal_seq DESC, priority DESC, ordinal DESC) AS r FROM u) WHERE r = 1"""))
def u1(spark, sf):
    from reelspark.functions import documents as d
    both = src.snapshot_candidates(generation_files(spark, sf)).unionByName(src.journal_events(journal_lines(spark, sf)), allowMissingColumns=True)
    both = both.select("session_dir", d.text(C("snapshot"), "$.session_id").alias("session_id"), "journal_seq", "priority", "ordinal")
    return op.latest_snapshot(both).drop("session_id")


@query("k7_state_compaction", b.with_tables("telemetry", """
  SELECT session_id, max(seq) AS journal_seq, arg_max(phase, seq) AS event, arg_max(committed_samples, seq) AS committed_samples FROM telemetry GROUP BY 1"""))
def k7(spark, sf):
    t = b.telemetry(spark, sf).select("session_id", C("seq").alias("journal_seq"), C("phase").alias("event"), "committed_samples")
    old = op.compact(t.where("journal_seq % 2 = 0"))
    return op.compact(t.where("journal_seq % 2 = 1"), old)
