"""Readers and writers on real files."""

import hashlib
import random
import struct
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.functions.text import fixed6
from reelspark.operators import delivery, fleet
from reelspark.sinks import writers
from reelspark.sources import logs, recordings, wav


def wave(data, code=1, bits=16, rf64=False, fact=None):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, code, 1, 48_000, 48_000 * bits // 8, bits // 8, bits)
    mid = b"fact" + struct.pack("<II", 4, fact) if fact is not None else b""
    size = 0xFFFFFFFF if rf64 else len(data)
    tail = fmt + mid + b"data" + struct.pack("<I", size) + data
    if not rf64:
        return b"RIFF" + struct.pack("<I", 4 + len(tail)) + b"WAVE" + tail
    frames = len(data) // (bits // 8)
    tail += b"\0" * (len(data) % 2)  # this container always carries its pad byte
    total = 4 + 36 + len(tail)
    return b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, total, len(data), frames, 0) + tail


def test_wav_inventory_and_blocks(spark, tmp_path):
    i24 = b"".join(v.to_bytes(3, "little", signed=True) for v in (-8388608, 0, 4194304))
    f32 = np.array([0.5, -0.25], "<f4").tobytes()
    for name, content in {"a.wav": wave(struct.pack("<3h", -32768, 16384, 0)), "b.wav": wave(i24 + b"", bits=24)[:-1], "c.wav": wave(f32, 3, 32, fact=2),
                          "d.wav": wave(i24, bits=24, rf64=True), "e.wav": b"no", "f.wav": wave(i24, bits=24)}.items():
        (tmp_path / name).write_bytes(content)
    files = wav.read_files(spark, str(tmp_path))
    inv = wav.inventory(files).withColumn("name", F.element_at(F.split("path", "/"), -1))
    got = {r.name: (r.error, r.container, r.physical_frames, r.trailing_bytes, r.exact_header) for r in inv.collect()}
    assert got == {"a.wav": (None, "riff", 3, 0, True), "b.wav": (None, "riff", 2, 2, False), "c.wav": (None, "riff", 2, 0, True), "d.wav": (None, "rf64", 3, 0, True),
                   "e.wav": ("too_short", None, None, None, None), "f.wav": (None, "riff", 3, 0, True)}
    blocks = wav.pcm_blocks(wav.inventory(files).where("error is null"), 2).withColumn("name", F.element_at(F.split("path", "/"), -1))
    s = {}
    for r in blocks.orderBy("name", "block_start").collect():
        s.setdefault(r.name, []).extend(r.samples)
    assert s["a.wav"] == [-1.0, 0.5, 0.0] and s["d.wav"] == [-1.0, 0.0, 0.5] and s["c.wav"] == [0.5, -0.25]


def test_wav_beyond_prefix_and_two_gigabytes(spark, tmp_path):
    """Audio behind a chunk of 3 MB, and an RF64 file of 5 GB (sparse) whose last frames are read."""
    far = wave(struct.pack("<2h", 100, -100))
    far = far[:12] + b"LIST" + struct.pack("<I", 3_000_001) + b"x" * 3_000_002 + far[12:]
    (tmp_path / "far.wav").write_bytes(b"RIFF" + struct.pack("<I", len(far) - 8) + far[8:])
    frames = 2_600_000_000
    head = b"RF64" + struct.pack("<I", 0xFFFFFFFF) + b"WAVE" + b"ds64" + struct.pack("<IQQQI", 28, 72 + 2 * frames, 2 * frames, frames, 0) + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 48_000, 96_000, 2, 16) + b"data" + struct.pack("<I", 0xFFFFFFFF)
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(head)
        f.truncate(len(head) + 2 * frames)
        f.seek(-2, 2)
        f.write(struct.pack("<h", 16384))
    inv = wav.inventory(wav.read_files(spark, str(tmp_path))).withColumn("name", F.element_at(F.split("path", "/"), -1)).cache()
    got = {r.name: (r.error, r.container, r.physical_frames, r.exact_header) for r in inv.collect()}
    assert got == {"far.wav": (None, "riff", 2, True), "long.wav": (None, "rf64", frames, True)}
    last = inv.where("name = 'long.wav'").withColumn("data_at", F.col("data_at") + (frames - 3) * 2).withColumn("physical_frames", F.lit(3).cast("long"))
    assert [list(r.samples) for r in wav.pcm_blocks(last, 2).orderBy("block_start").collect()] == [[0.0, 0.0], [0.5]]


def test_recordings_logs_and_reports(spark, tmp_path):
    for p, content in {"r1/session.json": "{}", "r1/metadata/items.snapshot.json": "{}", "r2/audio/master-000001.wav": "x", "other/readme.txt": "x",
                       "r1/acceptance-report.json": '{"mode":"short","qualification":{"qualification_id":1,"run_id":2}}', "r2/acceptance-report.json": "{"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(content)
    listing = recordings.list_files(spark, str(tmp_path))
    found = recordings.recording_scan(listing, "file:" + str(tmp_path)).collect()
    assert {(r.session_dir, r.issue) for r in found} == {("r1", None), ("r2", "no_metadata")}
    assert {(r.parse_error, r.run_id) for r in fleet.read_reports(spark, str(tmp_path)).collect()} == {(False, 2), (True, None)}
    log = tmp_path / "log.jsonl"
    log.write_text('{"seq":1,"ts":"t","event":"e","message":"m"}\n{"seq":0,"ts":"t","event":"e","message":"m"}\n{bad\n')
    entries = logs.read_log(spark, str(log))
    assert [(r.seq, r.level, r.source, r.category) for r in entries.collect()] == [(1, "info", "ui", "app")]
    writers.write_log_text(entries, str(tmp_path / "text"))
    assert [r.value for r in spark.read.text(str(tmp_path / "text")).collect()] == ["t  INFO   ui/app  e  m"]


def test_manifest_sink(spark, tmp_path):
    files = spark.createDataFrame([("b", bytearray(b"2")), ("a", bytearray(b"1"))], "path string, content binary")
    writers.write_sha256(files, str(tmp_path / "m"))
    assert sorted(r.value[-3:] for r in spark.read.text(str(tmp_path / "m")).collect()) == [" *a", " *b"]
    try:
        writers.write_sha256(files.union(files), str(tmp_path / "n"))
        raise AssertionError("a repeated path must fail")
    except Exception as e:  # noqa: BLE001
        assert "listed twice" in str(e)


def test_manifest_of_files_of_any_length(spark, tmp_path):
    """A sparse file of over 2 GiB is hashed where it lies."""
    big, small = tmp_path / "big.bin", tmp_path / "small.bin"
    with open(big, "wb") as f:
        f.write(b"head")
        f.truncate((2 << 30) + 5)
    small.write_bytes(b"x")
    want = hashlib.sha256(b"head")
    for _ in range(2048):
        want.update(bytes(1 << 20))
    want.update(b"\0")
    got = {r.line for r in fleet.manifest(spark.createDataFrame([(str(big),), (str(small),)], "path string")).collect()}
    assert got == {f"{want.hexdigest()} *{big}", f"{hashlib.sha256(b'x').hexdigest()} *{small}"}


def test_daily_rows_roll_up_without_the_takes(spark):
    """Two days' tables made apart give what all takes at once give; sessions and lengths within the sketches' error."""
    takes = spark.range(60_000).select((F.col("id") % 3).alias("device"), (F.col("id") % 2).alias("day"), (F.col("id") % 5000).alias("session_id"), F.lit(0).cast("long").alias("start_sample"), (F.col("id") * 7 % 10_000).alias("end_sample"), (F.col("id") % 4 == 0).alias("flagged"))
    daily = fleet.fleet_daily(takes.where("day = 0"), "device").unionByName(fleet.fleet_daily(takes.where("day = 1"), "device"))
    got = {(r.device, r.day): r for r in fleet.from_daily(daily, 48000, "device").collect()}
    assert got[None, None].takes == 60_000 and got[None, None].flagged == 15_000 and got[1, None].takes == 20_000 and got[1, 1].takes == 10_000
    assert abs(got[None, None].sessions - 5000) < 150 and abs(got[None, None].hours - 60_000 * 4999.5 / 48000 / 3600) < 1e-6
    lengths = {(r.device, r["rank"]): r.samples for r in fleet.length_quantiles(daily, [0.1, 0.5, 0.9], "device").collect()}
    assert len(lengths) == 9 and all(abs(v - q * 10_000) < 300 for (_, q), v in lengths.items())


def test_daily_sessions_are_exact(spark):
    """Over days made apart as well; a sketch of 2^14 registers is off by some of these."""
    takes = spark.range(90_000).select(F.lit(1).alias("device"), (F.col("id") % 2).alias("day"), (F.col("id") % 30_001).alias("session_id"), F.lit(0).cast("long").alias("start_sample"), F.col("id").alias("end_sample"), F.lit(False).alias("flagged"))
    daily = fleet.fleet_daily(takes.where("day = 0"), "device").unionByName(fleet.fleet_daily(takes.where("day = 1"), "device"))
    got = {(r.device, r.day): r.sessions for r in fleet.from_daily(daily, 48000, "device").collect()}
    assert got == {(r.device, r.day): r.n for r in takes.rollup("device", "day").agg(F.count_distinct("session_id").alias("n")).collect()}


def test_paths(spark):
    cases = [("/rep", "/rep/a", True), ("/rep", "/rep", True), ("/rep", "/report/a", False), ("/rep", "/rep/../x", False), ("/rep/", "/x/../rep//./b", True), ("/rep", "rep/a", False), ("/rep", None, False),
             ("/rep/a", "/rep", False), ("C:\\rep", "C:\\rep\\s\\..\\t", True), ("/", "/../../a", True)]
    df = spark.createDataFrame(cases, "root string, path string, inside boolean")
    assert [r[0] for r in df.select(paths.within(F.col("root"), F.col("path")) == F.col("inside")).collect()] == [True] * len(cases)


def test_manifest_parts_are_bounded(spark):
    rows = spark.range(2500).select(F.lit(1).alias("session_id"), F.col("id").alias("pos"), F.col("id").alias("item_id"), F.lit("a").alias("attempt_id"), (F.col("id") % 2 == 0).alias("exported"))
    source = spark.createDataFrame([(1, 7, 900)], "session_id int, journal_seq long, committed_samples long")
    parts = delivery.manifest_parts(rows, source, 1000).collect()
    assert all(p.document.startswith('{"source":{"journal_seq":7,"committed_samples":900,"selected_attempts":[') for p in parts)
    assert sorted((p.part, p.n_exported + p.n_skipped) for p in parts) == [(0, 1000), (1, 1000), (2, 500)]


def test_delivery_csv_has_its_header_first_and_rows_in_order(spark, tmp_path):
    cols = {c: F.lit(1) for c in delivery.CSV_COLUMNS if c not in ("id", "forced_without_tail_silence", "content_started_seconds")}
    rows = spark.range(25).select((F.col("id") % 2).alias("session_id"), F.col("id").alias("pos"), F.concat(F.lit("t"), 99 - F.col("id")).alias("id"), F.lit(False).alias("forced_without_tail_silence"), F.lit(0.5).alias("content_started_seconds"), *[v.alias(k) for k, v in cols.items()])
    writers.write_delivery_csv(delivery.csv_lines(rows.repartition(5), 4), str(tmp_path / "csv"), 8)
    for s, n in ((0, 13), (1, 12)):
        parts = sorted((tmp_path / "csv" / f"session_id={s}").iterdir(), key=lambda p: int(p.name.split("=")[1]))
        files = [[f for f in p.iterdir() if f.suffix == ".txt"] for p in parts]
        assert [len(f) for f in files] == [1] * len(files)
        lines = "".join(f.read_text() for (f,) in files).splitlines()
        assert lines[0] == ",".join(delivery.CSV_COLUMNS) and [x.split(",")[0] for x in lines[1:]] == [f'"t{99 - s - 2 * i}"' for i in range(n)]


def test_six_decimals_follow_the_exact_value(spark):
    rng = random.Random(3)
    values = [i / 48000 for i in range(1000)] + [i * 375 / 48000 for i in range(50)] + [i * 10.0 ** -rng.randrange(1, 14) for i in range(2000)] + [0.0, 5e-7, 4.9e-7, 0.9999995, 2.0 ** -20, 2.0 ** -10, 2.0 ** -31, 5e-324, 1e9 + 0.1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", fixed6("v").alias("s")).collect()
    bad = [(r.v, r.s) for r in got if r.s != str(Decimal(r.v).quantize(Decimal("0.000001"), ROUND_HALF_UP, Context(prec=60)))]
    assert not bad


def test_states_and_logs_are_replaced_per_session(spark, tmp_path):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "session_dir string, journal_seq long")
    writers.write_states(old, str(tmp_path / "s"))
    writers.write_states(spark.createDataFrame([("b", 7)], "session_dir string, journal_seq long"), str(tmp_path / "s"))
    assert {(r.session_dir, r.journal_seq) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", 1), ("b", 7)}
    rows = spark.createDataFrame([("x", i) for i in range(9)] + [("y", 1)], "store string, seq long")
    writers.rewrite_logs(rows, str(tmp_path / "l"), 3)
    assert {(r.store, r.seq) for r in spark.read.json(str(tmp_path / "l")).collect()} == {("x", 6), ("x", 7), ("x", 8), ("y", 1)}
