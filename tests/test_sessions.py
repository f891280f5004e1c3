from pyspark.sql import functions as F

from reelspark.functions import levels, storage, text
from reelspark.operators import delivery, fleet, sessions
from reelspark.plans import history
from reelspark.sources import snapshots


def test_latest_snapshot_needs_one_identity(spark):
    rows = [("d", "s", 2, 20, 1), ("d", "s", 3, 10, 2), ("d", "s", 4, 40, 7), ("e", "s", 9, 40, 7), ("e", "x", 1, 30, 0)]
    c = spark.createDataFrame(rows, "session_dir string, session_id string, journal_seq long, priority int, ordinal long")
    assert [(r.session_dir, r.journal_seq) for r in sessions.latest_snapshot(c).collect()] == [("d", 4)]
    assert {r.session_dir: r.trusted_id for r in sessions.identity(c).collect()} == {"d": "s", "e": None}


def test_interrupted_takes_run_twice(spark):
    started = spark.createDataFrame([("s", "a", 1, 100), ("s", "b", 5, 900)], "session_id string, attempt_id string, seq long, start_sample long")
    stopped = spark.createDataFrame([("s", "b", 6)], "session_id string, attempt_id string, seq long")
    durable = spark.createDataFrame([("s", "recording", 3, 333)], "session_id string, status string, journal_seq long, physical_frames long")
    out = sessions.interrupted_takes(started, stopped, durable).collect()
    assert [(r.attempt_id, r.start_sample, r.end_sample, r.journal_seq) for r in out] == [("a", 100, 333, 4)]
    assert sessions.interrupted_takes(started, stopped, durable.withColumn("status", F.lit("stopped"))).count() == 0


SNAP = ('{"schema_version":1,"session_id":"s","journal_seq":%s,"status":"recording","device_name":"m","audio_format":{"sample_rate":48000,"channels":1,"input_channels":1},'
        '"master_audio":"a","captured_samples":9,"committed_samples":9,"overflow_samples":0,"started_at":"x","updated_at":"y","items":[]%s}')
SPAN = ',"capture_provenance":[{"start_sample":0,"end_sample":%d,"device_name":"m","device_id":"d","input_sample_format":"i24","input_channels":2,"input_channel":1,"sample_rate":48000}]'


def test_snapshot_files_and_journal(spark, tmp_path):
    meta = tmp_path / "rec" / "metadata"
    meta.mkdir(parents=True)
    (meta / "items.snapshot.json").write_text("{broken")
    (meta / "items.snapshot.tmp").write_text(SNAP % (2, ""))
    (meta / "items.snapshot.prev").write_text(SNAP % (3, SPAN % 9))
    (meta / "items.snapshot.backup").write_text(SNAP % (8, SPAN % 8))
    event = lambda seq, inner: '{"journal_seq":%d,"event":"e","snapshot":%s}' % (seq, SNAP % (inner, ""))
    (meta / "events.jsonl").write_text("\n".join([event(4, 4), event(98, 99), "{torn", event(5, '"5"'), '{"journal_seq":6,"event":""}']))
    files = snapshots.snapshot_candidates(snapshots.read_snapshot_files(spark, str(tmp_path)))
    lines = snapshots.journal_events(snapshots.read_journals(spark, str(tmp_path)))
    assert sorted((r.journal_seq, r.priority) for r in files.collect()) == [(2, 20), (3, 10)]
    assert [(r.journal_seq, r.priority) for r in lines.collect()] == [(4, 40)]
    assert {r.session_dir for r in files.select("session_dir").union(lines.select("session_dir")).collect()} == {str(tmp_path / "rec")}
    newest = sessions.latest_snapshot(snapshots.candidate_rows(snapshots.read_snapshot_files(spark, str(tmp_path)), snapshots.read_journals(spark, str(tmp_path)))).collect()
    assert [(r.session_dir, r.journal_seq, r.priority) for r in newest] == [(str(tmp_path / "rec"), 4, 40)]


def test_history_page_from_files(spark, tmp_path):
    """Every recording folder has its row: trusted, in conflict, without usable state, without metadata."""
    event = lambda seq, snap: '{"journal_seq":%d,"event":"e","snapshot":%s}' % (seq, snap)
    item = '"items":[{"id":"i","text":"t","label":"","status":"%s","attempts":[]}]'
    snap = lambda seq, who, status: (SNAP % (seq, "")).replace('"session_id":"s"', f'"session_id":"{who}"').replace('"items":[]', item % status)
    for name, content in {"good 1+中/metadata/items.snapshot.json": snap(2, "a", "pending"), "good 1+中/metadata/events.jsonl": event(3, snap(3, "a", "accepted")),
                          "split/metadata/items.snapshot.json": snap(2, "b", "pending"), "split/metadata/items.snapshot.prev": snap(1, "c", "pending"),
                          "torn/metadata/items.snapshot.json": "{", "bare/audio/master-000001.wav": "x", "marked/metadata/items.snapshot.json": snap(1, "d", "skipped"), "marked/metadata/audio-fault.tmp": "{",
                          "other/readme.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    got = {r.session_dir.rsplit("/", 1)[1]: (r.session_id, r.status, r.history_issue, r.journal_seq, r.total_items, r.accepted_items) for r in history.page_from_files(spark, str(tmp_path)).collect()}
    assert got == {"good 1+中": ("a", "recording", False, 3, 1, 1), "split": ("split", "invalid", True, None, 0, 0), "torn": ("torn", "invalid", True, None, 0, 0),
                   "bare": ("bare", "invalid", True, None, 0, 0), "marked": ("d", "faulted", False, 1, 1, 0)}
    assert len(history.page_from_files(spark, str(tmp_path), 1, 2).collect()) == 2


def test_export_space(spark):
    new = [1000, 400, 300, 100]
    rows = [(1, i, n, 0, 0) for i, n in enumerate(new)] + [(2, i, n, 0 if i == 3 else n, 0) for i, n in enumerate(new)]
    df = spark.createDataFrame(rows, "export_id long, step long, new_bytes long, replaced_bytes long, available_bytes long")
    assert {r.export_id: r.peak_additional_bytes for r in delivery.export_peak(df, 2, 10).collect()} == {1: 1800, 2: 1000}


def test_byte_rates_and_levels(spark):
    df = spark.createDataFrame([(48_000, 1, 16), (48_000, 1, 24), (48_000, 1, 32), (48_000, 2, 32), (48_000, 1, 20)], "r long, c long, b long")
    got = [x.v for x in df.select(storage.bytes_per_second(F.col("r"), F.col("c"), F.col("b")).alias("v")).collect()]
    assert got == [96_000, 144_000, 192_000, 384_000, None]
    bins = spark.createDataFrame([([0.5, 0.25],), ([-0.5, -2.0],)], "s array<float>").select(levels.bin_envelope(F.col("s")).alias("e")).collect()
    assert [tuple(b.e) for b in bins] == [(0.0, 0.5), (-1.0, 0.0)]


def test_six_decimals_follow_the_binary_value(spark):
    values = [128163 / 48000, 0.0, 0.9999999, 2.5, 525123 / 48000, 1e-7, 12345.0000005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(text.fixed6("v").alias("t")).collect()] == ["%.6f" % v for v in values]


def test_torn_evidence(spark):
    rows = [("ok", 1, "{}", True), ("torn", 1, "{}", True), ("torn", 2, '{"a', False), ("bad", 1, '{"a', True), ("bad", 2, "{}", True)]
    df = spark.createDataFrame(rows, "file string, line_no long, text string, terminated boolean")
    assert {r.file: r.verdict for r in fleet.ndjson_verdict(df, True).collect()} == {"ok": "sound", "torn": "torn_tail", "bad": "damaged"}
    assert {r.file: r.verdict for r in fleet.ndjson_verdict(df, False).collect()}["torn"] == "damaged"


def test_paging_by_key_gives_every_row_once(spark):
    dirs = spark.range(53).select((F.col("id") % 7).alias("modified_at"), F.col("id").alias("session_dir"))
    want = [(r.modified_at, r.session_dir) for r in dirs.orderBy(F.desc("modified_at"), "session_dir").collect()]
    got, last = [], None
    while page := [(r.modified_at, r.session_dir) for r in history.page_after(dirs, last, 20).collect()]:
        got, last = got + page, page[-1]
    assert got == want


def test_journal_lines_are_dealt_out_before_parsing(spark, monkeypatch):
    from reelspark.catalog import streams

    seen, whole = [], streams.live.journal_tail
    monkeypatch.setattr(streams.live, "journal_tail", lambda lines, late: seen.append(lines._jdf.queryExecution().logical().toString()) or whole(lines, late))
    assert streams.x11(spark, "/root/testdata/sf0.001").count() > 0
    assert len(seen) == 3 and all("Repartition" in plan for plan in seen)
