"""Session snapshots and the journal that carries them."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions import documents as d

C = F.col

# File name of each snapshot generation, its priority, in reading order.
GENERATIONS = (
    ("items.snapshot.json", 30), ("items.snapshot.tmp", 20), ("items.snapshot.prev", 10), ("items.snapshot.backup", 9),
    ("items.snapshot.json.prev", 10), ("items.snapshot.json.backup", 9), ("items.snapshot.json.bak", 8))
JOURNAL_PRIORITY = 40


def _all(checks: list[Column]) -> Column:
    return reduce(and_, checks)


def attempt_valid(a: Column) -> Column:
    counts = ("recording_started_sample", "head_silence_armed_sample", "head_silence_passed_sample", "required_head_silence_samples",
              "content_started_sample", "tail_silence_samples", "required_tail_silence_samples")
    return _all([
        d.is_text(a, "$.attempt_id"), d.is_count(a, "$.start_sample"), d.is_count(a, "$.end_sample"),
        *[d.absent_or(a, f"$.{n}", d.is_count(a, f"$.{n}")) for n in counts],
        d.absent_or(a, "$.forced_without_tail_silence", d.is_bool(a, "$.forced_without_tail_silence")),
        d.is_text(a, "$.status"), d.is_text(a, "$.created_at")])


def item_valid(i: Column) -> Column:
    selected = d.type_of(i, "$.selected_attempt_id")
    return _all([
        *[d.is_text(i, f"$.{n}") for n in ("id", "text", "label", "status")],
        d.is_array(i, "$.attempts"),
        F.coalesce(F.forall(d.elements(i, "$.attempts"), attempt_valid), F.lit(False)),
        selected.isNull() | selected.isin("VOID", "STRING")])


def noise_check_valid(s: Column) -> Column:
    t = d.type_of(s, "$.noise_check")
    full = _all([
        d.is_bool(s, "$.noise_check.passed"),
        *[d.is_number(s, f"$.noise_check.{n}") for n in ("threshold_dbfs", "average_dbfs", "maximum_dbfs")],
        d.is_count(s, "$.noise_check.failing_windows"), d.is_array(s, "$.noise_check.samples"),
        F.coalesce(F.forall(d.elements(s, "$.noise_check.samples"), lambda x: d.is_number(x, "$")), F.lit(False)),
        d.is_text(s, "$.noise_check.completed_at")])
    return t.isNull() | (t == "VOID") | full


def _spans_valid(s: Column) -> Column:
    """Spans tile [0, committed). The cursor runs through the array of one document."""
    rate, committed = d.whole(s, "$.audio_format.sample_rate"), d.whole(s, "$.committed_samples")

    def step(cursor: Column, span: Column) -> Column:
        end = d.whole(span, "$.end_sample")
        ok = _all([
            d.is_count(span, "$.start_sample"), F.coalesce(d.whole(span, "$.start_sample") == cursor, F.lit(False)),
            d.is_count(span, "$.end_sample"), F.coalesce((end >= cursor) & (end <= committed), F.lit(False)),
            d.is_text(span, "$.device_name"), d.is_text(span, "$.device_id"), d.is_text(span, "$.input_sample_format"),
            F.coalesce(F.trim(d.text(span, "$.input_sample_format")) != "", F.lit(False)),
            d.is_positive(span, "$.input_channels"), d.is_positive(span, "$.input_channel"),
            F.coalesce(d.whole(span, "$.input_channel") <= d.whole(span, "$.input_channels"), F.lit(False)),
            F.coalesce(d.whole(span, "$.sample_rate") == rate, F.lit(False))])
        return F.when(ok, end).otherwise(F.lit(-1).cast("long"))

    spans = d.elements(s, "$.capture_provenance")
    cursor = F.aggregate(spans, F.lit(0).cast("long"), step)
    tiled = d.is_array(s, "$.capture_provenance") & F.coalesce((F.size(spans) == 0) | (cursor == committed), F.lit(False))
    return d.absent_or(s, "$.capture_provenance", tiled)


def snapshot_valid(s: Column) -> Column:
    """Is the document a complete version-1 snapshot?"""
    f = "$.audio_format"
    rate, frames = d.whole(s, f"{f}.sample_rate"), d.whole(s, "$.segment_frames")
    layout = d.type_of(s, "$.storage_layout_version")
    mode = d.type_of(s, "$.capture_share_mode")
    optional_text = ("script_name", "device_id", "input_sample_format")
    return F.coalesce(_all([
        d.is_number(s, "$.schema_version") & F.coalesce(d.whole(s, "$.schema_version") == 1, F.lit(False)),
        d.is_text(s, "$.session_id"), F.coalesce(F.trim(d.text(s, "$.session_id")) != "", F.lit(False)),
        d.absent_or(s, "$.journal_seq", d.is_count(s, "$.journal_seq")),
        *[d.absent_or(s, f"$.{n}", d.is_text(s, f"$.{n}")) for n in optional_text],
        *[d.is_text(s, f"$.{n}") for n in ("status", "device_name", "master_audio", "started_at", "updated_at")],
        mode.isNull() | F.coalesce((mode == "STRING") & d.text(s, "$.capture_share_mode").isin("exclusive", "shared"), F.lit(False)),
        *[d.is_positive(s, f"{f}.{n}") for n in ("sample_rate", "channels", "input_channels")],
        *[d.absent_or(s, f"{f}.{n}", d.is_count(s, f"{f}.{n}")) for n in ("bit_depth", "input_channel")],
        d.absent_or(s, f"{f}.encoding", d.is_text(s, f"{f}.encoding")),
        layout.isNull() | F.coalesce((layout == "BIGINT") & (d.whole(s, "$.storage_layout_version") == 1), F.lit(False)),
        d.absent_or(s, "$.segment_frames", d.is_positive(s, "$.segment_frames") & F.coalesce(frames.between(rate, rate * 3600), F.lit(False))),
        *[d.is_count(s, f"$.{n}") for n in ("captured_samples", "committed_samples", "overflow_samples")],
        _spans_valid(s), noise_check_valid(s),
        d.absent_or(s, "$.silence_duration_ms", d.is_count(s, "$.silence_duration_ms")),
        *[d.absent_or(s, f"$.{n}", d.is_number(s, f"$.{n}")) for n in ("silence_threshold_dbfs", "noise_threshold_dbfs")],
        d.is_array(s, "$.items"), F.coalesce(F.forall(d.elements(s, "$.items"), item_valid), F.lit(False)),
    ]), F.lit(False))


def _generation(name: Column, what: int) -> Column:
    out = F.lit(None)
    for ordinal, (file, priority) in enumerate(GENERATIONS):
        out = F.when(name == file, priority if what == 0 else ordinal).otherwise(out)
    return out.cast("int")


def snapshot_candidates(files: DataFrame) -> DataFrame:
    """Candidates from snapshot files (session_dir, name, modified_at, text)."""
    rows = d.parse_rows(files, "text", "snapshot").select(
        "session_dir", "modified_at", "snapshot", _generation(C("name"), 0).alias("priority"), _generation(C("name"), 1).cast("long").alias("ordinal"))
    rows = rows.where(C("priority").isNotNull() & snapshot_valid(C("snapshot")))
    return rows.withColumn("journal_seq", F.coalesce(d.whole(C("snapshot"), "$.journal_seq"), F.lit(0).cast("long")))


def journal_events(lines: DataFrame) -> DataFrame:
    """Usable journal lines (session_dir, line_no, modified_at, text) as candidates.

    A damaged line is skipped: every event carries the full projection. The event's own
    number must equal the one inside its snapshot.
    """
    rows = d.parse_rows(lines, "text", "e").select("*", F.explode(F.array(d.at(C("e"), "$.snapshot"))).alias("snap"))
    snap = C("snap")
    ok = (d.is_text(C("e"), "$.event") & F.coalesce(d.text(C("e"), "$.event") != "", F.lit(False))
          & d.is_positive(C("e"), "$.journal_seq") & snapshot_valid(snap))
    rows = rows.where(ok).select(
        "session_dir", "modified_at", d.text(C("e"), "$.event").alias("event"), d.whole(C("e"), "$.journal_seq").alias("event_seq"),
        snap.alias("snapshot"), F.lit(JOURNAL_PRIORITY).alias("priority"), (C("line_no") + len(GENERATIONS)).alias("ordinal"))
    rows = rows.withColumn("journal_seq", F.coalesce(d.whole(C("snapshot"), "$.journal_seq"), F.lit(0).cast("long")))
    return rows.where("journal_seq = event_seq").drop("event_seq")


def folder_of(path: Column) -> Column:
    """Recording folder of a metadata file, written alike whichever reader gave the path.

    Readers differ in local paths only (``file:/x``, ``file:///x``, ``/x``); other stores keep their scheme.
    """
    return F.regexp_extract(F.regexp_replace(path, r"^file:/*(?=/)", ""), r"^(.*)/metadata/[^/]+$", 1)


def candidate_rows(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Candidates of both kinds with the columns that history needs; ``item_statuses`` has one entry per item."""
    rows = snapshot_candidates(files).unionByName(journal_events(lines), allowMissingColumns=True)
    s = C("snapshot")
    return rows.select(
        "session_dir", d.text(s, "$.session_id").alias("session_id"), "journal_seq", "priority", "ordinal", "modified_at", d.text(s, "$.status").alias("status"),
        *[d.whole(s, f"$.{n}").alias(n) for n in ("overflow_samples", "committed_samples", "captured_samples")],
        F.transform(d.elements(s, "$.items"), lambda i: d.text(i, "$.status")).alias("item_statuses"))


def read_snapshot_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Snapshot generations below ``root``, whatever their size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "items.snapshot.*").load(root)
    return files.select(
        folder_of(C("path")).alias("session_dir"), F.element_at(F.split("path", "/"), -1).alias("name"),
        C("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("text"))


def read_journals(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Journal lines below ``root``, split by Spark, never a whole file in one row.

    A line's order is its split's byte offset, then its place within the split: the row
    part of the generated id counts up while one task reads the split. Both fit a decimal
    for files of any length.
    """
    lines = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "events.jsonl").text(root)
             .select("value", "_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    place = C("file_block_start").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + C("row").bitwiseAND(F.lit(0x1_FFFF_FFFF)).cast("decimal(10,0)")
    path = F.url_decode(F.replace(C("file_path"), F.lit("+"), F.lit("%2B")))  # the metadata column escapes what the other reader doesn't
    return lines.select(folder_of(path).alias("session_dir"), place.cast("decimal(31,0)").alias("line_no"), C("file_modification_time").alias("modified_at"), C("value").alias("text"))
