"""Rules as rows: (subject, check_id, status), and verdicts over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import formats, paths

C = F.col


def check_list(checks: list[tuple]) -> Column:
    """The checks of ``check_rows`` as one array of (check_id, status)."""
    rows = []
    for check_id, condition, *severity in checks:
        name = check_id if isinstance(check_id, Column) else F.lit(check_id)
        status = F.when(F.coalesce(condition, F.lit(False)), "PASS").otherwise(severity[0] if severity else "FAIL")
        rows.append(F.struct(name.alias("check_id"), status.alias("status")))
    return F.array(*rows)


def check_rows(facts: DataFrame, keys: list[str], checks: list[tuple]) -> DataFrame:
    """One row per key and check; a null condition counts as not met.

    A check is (id, condition) or (id, condition, severity); the ids may be columns.
    """
    return facts.select(*keys, F.inline(check_list(checks)))


def acceptance(incomplete: Column, failed: Column) -> Column:
    return F.when(incomplete, "INCOMPLETE").when(failed, "FAIL").otherwise("PASS")


def acceptance_verdict(checks: DataFrame, reports: DataFrame, keys: list[str]) -> DataFrame:
    """INCOMPLETE before FAIL before PASS; warnings pass, and so does a report without checks."""
    failed = checks.groupBy(*keys).agg(F.count_if(C("status") == "FAIL").alias("failed"))
    out = reports.join(failed, keys, "left")
    return out.select(*keys, acceptance(C("incomplete"), C("failed") > 0).alias("overall"))


def qualification_verdict(plan_checks: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """QUALIFIED iff every plan check and every result passes and there is a result."""
    p = plan_checks.groupBy(key).agg(F.bool_and(C("status") == "PASS").alias("plan_ok"))
    r = results.groupBy(key).agg(F.bool_and(C("status") == "PASS").alias("runs_ok"))
    out = p.join(r, key, "full")
    ok = F.coalesce("plan_ok", F.lit(True)) & F.coalesce("runs_ok", F.lit(False))
    return out.select(key, F.when(ok, "QUALIFIED").otherwise("NOT_QUALIFIED").alias("overall"))


def inventory_checks(devices: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per host: devices present, ids there, ids unique, configurations present."""
    has_id = F.coalesce(C("device_id") != "", F.lit(False))
    facts = devices.groupBy("host_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has_id).alias("with_id"), F.count_distinct(F.when(has_id, C("device_id"))).alias("distinct_ids"),
        F.count_if(C("n_configurations") > 0).alias("configured"))
    facts = hosts.join(facts, "host_id", "left").fillna(0)
    return check_rows(facts, ["host_id"], [
        ("devices-present", C("n") > 0), ("stable-device-ids", C("with_id") == C("n")),
        ("unique-device-ids", C("distinct_ids") == C("with_id")), ("driver-configurations", C("configured") == C("n"))])


def sealed_session_checks(facts: DataFrame) -> DataFrame:
    """``facts``: one row per session with snapshot, segment and marker columns."""
    some = C("segments") > 0
    return check_rows(facts, ["session_id"], [
        ("real-recording-tree", C("tree_errors") == 0), ("metadata-readable", C("metadata_errors") == 0),
        ("snapshot-present", C("status").isNotNull()), ("segments-present", some), ("no-segment-errors", C("segment_errors") == 0),
        ("segment-layout-valid", C("layout_errors") == 0), ("segment-descriptors-valid", C("descriptor_errors") == 0),
        ("segment-descriptor-redundancy", C("descriptor_issues") == 0, "WARN"),
        ("exact-segment-headers", some & (C("inexact_headers") == 0)), ("no-trailing-frame-bytes", some & (C("trailing_segments") == 0)),
        ("segment-format-consistent", some & (C("foreign_formats") == 0)), ("stopped-status", C("status") == "stopped"),
        ("no-overflow", C("overflow_samples") == 0), ("no-fault-marker", ~C("fault_marker")),
        ("exact-sample-watermark", (C("captured_samples") == C("committed_samples")) & (C("committed_samples") == C("physical_frames"))),
        ("session-summary-consistent", (C("summary_seq") == C("journal_seq")) & (C("summary_status") == C("status"))),
        ("full-track-readable-if-present", ~C("full_track_error"))])


def capture_checks(facts: DataFrame, rate: int, delivery_bits: int) -> DataFrame:
    """Common rules of every capture run over its progress summary."""
    return check_rows(facts, ["session_id"], [
        ("captured-monotonic", C("captured_monotonic")), ("committed-monotonic", C("committed_monotonic")),
        ("file-growth-monotonic", C("file_bytes_monotonic")), ("commit-lag", C("max_commit_lag_seconds") <= 15),
        ("no-capture-fault", C("first_fault_seq").isNull()),
        ("continuous-file-growth", C("max_file_growth_stall_seconds") <= C("allowed_file_growth_stall_seconds")),
        ("capture-clock-rate", C("observed_capture_rate").between(rate * 0.95, rate * 1.05)),
        ("signal-observed", C("maximum_peak_dbfs") > -50), ("no-clipping", C("maximum_peak_dbfs") < -0.1, "WARN"),
        ("input-precision", C("precision_bits") >= delivery_bits), ("storage-health", C("first_critical_seq").isNull(), "WARN")])


def capture_session_checks(facts: DataFrame) -> DataFrame:
    """What was asked of a capture run against the session it left: device, format, segments, stop and full track.

    ``facts``: snapshot and inventory columns of the session beside ``requested`` (rate, bits, channel, share_mode, precision,
    export) and ``track`` (exact_header, frames, rate, bits, channels) of the exported full track.
    """
    some, asked, track = C("segments") > 0, lambda c: C(f"requested.{c}"), lambda c: C(f"track.{c}")
    whole = track("exact_header") & (track("frames") == C("committed_samples")) & (track("rate") == C("sample_rate")) & (track("bits") == C("bit_depth")) & (track("channels") == 1)
    return check_rows(facts, ["session_id"], [
        ("engine-ready", C("engine_ready")), ("device-id-match", C("device_id").eqNullSafe(C("selected_id"))), ("sample-rate-match", C("sample_rate") == asked("rate")),
        ("wav-bit-depth-match", C("bit_depth") == asked("bits")), ("input-channel-match", C("input_channel") == asked("channel")), ("capture-share-mode-match", C("share_mode") == asked("share_mode")),
        ("input-format-recorded", C("input_format") != ""), ("input-format-minimum", formats.precision_bits(C("input_format")) >= asked("precision")),
        ("segment-wav-readable", some & (C("segment_errors") == 0)), ("segment-format-match", some & (C("foreign_formats") == 0)), ("physical-frame-watermark", C("physical_frames") == C("committed_samples")),
        ("safe-stop", C("stop_result") & C("stop_error").isNull()), ("stopped-status", C("status") == "stopped"),
        ("exact-sample-watermark", (C("captured_samples") >= 0) & (C("captured_samples") == C("committed_samples")) & (C("committed_samples") == C("physical_frames"))),
        ("no-overflow", F.coalesce("overflow_samples", F.lit(0)) == 0), ("no-fault-marker", ~C("fault_marker")), ("exact-segment-headers", some & (C("inexact_headers") == 0)),
        ("full-track-export", ~asked("export") | whole)])


def fault_checks(facts: DataFrame, rate: int) -> DataFrame:
    """Rules of a provoked fault; unplug runs are judged by kind and latency, others by the disk."""
    unplug = C("mode").isin("unplug", "replug", "default-switch")
    after, disk = C("seconds_after_trigger"), C("seconds_after_critical")
    return check_rows(facts, ["session_id"], [
        ("healthy-prefix", C("captured_before_trigger") >= rate * 2), ("fault-detected", C("fault_elapsed").isNotNull()),
        ("fault-after-trigger", ~unplug | (after >= 0)), ("unplug-detection-latency", ~unplug | after.between(0, 15)),
        ("unplug-fault-kind", ~unplug | (C("first_kind") == "device_unavailable")),
        ("disk-critical-latency", unplug | (disk <= 5)), ("fault-marker", C("fault_marker")), ("faulted-status", C("status") == "faulted"), ("normal-export-blocked", C("export_rejected")),
        ("captured-prefix-preserved", (C("physical_frames") > 0) & (C("trailing_segments") == 0)), ("timeline-stopped-after-fault", C("stopped"))])


def phase1_checks(facts: DataFrame, rate: int, max_tail_seconds: float, production_seconds: int = 3600) -> DataFrame:
    """Evidence of the first half of a power-cut run against the session found after it."""
    requested = int(-(-max_tail_seconds * rate // 1))
    minimum = F.when(C("test_only"), 2).otherwise(production_seconds)
    lag = C("armed_captured") - C("armed_committed")
    return check_rows(facts, ["session_id"], [
        ("phase1-evidence-schema", (C("evidence_version") == 1) & (C("phase") == "armed") & (F.length("nonce") >= 16)),
        ("interrupted-preseal-status", C("status").isin("recording", "stopping")),
        ("phase1-session-identity", C("evidence_device_id") == C("device_id")),
        ("power-cut-qualification-class", C("production_eligible") != C("test_only")),
        ("phase1-minimum-duration", (C("required_seconds") >= minimum) & (C("wall_seconds") >= C("required_seconds"))
         & (C("armed_committed") >= F.ceil(C("required_seconds") * rate))),
        ("phase1-tail-budget", (lag >= 0) & (lag <= F.least(C("evidence_tail_limit"), F.lit(requested)))),
        ("host-rebooted-after-arm", (C("boot_id") != C("evidence_boot_id")) & (C("booted_at_ms") > C("armed_at_ms") + 1000))])


def same_document(a, b):
    """Do two JSON texts say the same, whatever the order of their keys? VARIANT keeps keys sorted."""
    read = lambda x: F.to_json(F.try_parse_json(x))
    return F.coalesce(read(a) == read(b), F.lit(False))


def before_seal_checks(facts: DataFrame) -> DataFrame:
    """What has to hold before an interrupted session is sealed offline, and how the engine that did it ended.

    ``facts``: of the phase-1 input source_kind, report_mode, report_phase, report_session, evidence (JSON), evidence_session, evidence_path
    and the hashes of its binaries; of the session evidence_here (JSON), evidence_here_kind, its folder, the error counts of its
    tree and preseal_errors; the engine's exit_code, exit_signal and shutdown_error.
    """
    bound = (C("report_mode") == "power-cut") & (C("report_phase") == "armed") & (C("report_session") == C("evidence_session"))
    here = paths.steps(F.concat("session_dir", F.lit("/power-cut-evidence.json")))
    clean = F.lit(True)
    for c in ("tree_errors", "metadata_errors", "layout_errors", "descriptor_errors", "preseal_errors"):
        clean = clean & (C(c) == 0)
    return check_rows(facts, ["session_id"], [
        ("phase1-source-bound", (C("source_kind") == "evidence") | ((C("source_kind") == "report") & bound)),
        ("session-evidence-bound", (C("evidence_here_kind") == "power-cut-armed") & (paths.steps(C("evidence_path")) != here) & same_document(C("evidence"), C("evidence_here"))),
        ("recording-tree-safe-before-seal", clean), ("phase1-binaries-match", C("tool_sha256").eqNullSafe(C("evidence_tool_sha256")) & C("engine_sha256").eqNullSafe(C("evidence_engine_sha256"))),
        ("engine-clean-exit", (C("exit_code") == 0) & C("exit_signal").isNull() & C("shutdown_error").isNull())])


def armed_rows(polls: DataFrame, evidence: DataFrame) -> DataFrame:
    """The evidence of a session with the last poll at or before the moment it was armed (as-of), as armed_captured and armed_committed.

    ``polls``: session_id, seq, elapsed_seconds and the watermarks; ``evidence``: session_id, armed_seconds and more. A session
    that has no poll by then keeps nulls.
    """
    last = polls.join(evidence.select("session_id", "armed_seconds"), "session_id").where(C("elapsed_seconds") <= C("armed_seconds")).groupBy("session_id").agg(
        F.max_by(F.struct(C("captured_samples").alias("armed_captured"), C("committed_samples").alias("armed_committed")), F.struct("elapsed_seconds", "seq")).alias("a"))
    return evidence.join(last, "session_id", "left").select(*evidence.columns, "a.armed_captured", "a.armed_committed")


def recovery_checks(facts: DataFrame, rate: int, max_tail_seconds: float) -> DataFrame:
    """The session that an offline seal recovered against the armed poll before the power was cut.

    ``facts``: a row of ``armed_rows`` beside the seal's answer (seal_snapshot, no_op, seal_dir, durable_frames, seal_committed), the
    physical frames found, the folder of the run, evidence_tail_limit and how many original reports are bound to the run.
    """
    limit = F.least(C("evidence_tail_limit"), F.lit(int(-(-max_tail_seconds * rate // 1))))
    return check_rows(facts, ["session_id"], [
        ("phase1-original-report-selected", C("phase1_reports") == 1),
        ("offline-seal-complete", C("seal_snapshot") & ~C("no_op") & (paths.steps(C("seal_dir")) == paths.steps(C("session_dir")))),
        ("seal-watermark-consistent", (C("durable_frames") == C("physical_frames")) & (C("seal_committed") == C("physical_frames"))),
        ("armed-committed-preserved", C("physical_frames") >= C("armed_committed")),
        ("power-cut-tail-loss-budget", F.greatest(F.lit(0).cast("long"), C("armed_captured") - C("physical_frames")) <= limit)])


def preseal_recovery(segments: DataFrame, descriptors: DataFrame) -> DataFrame:
    """Unreadable segments that offline recovery must not rebuild, with the reason.

    A closed segment may never be rebuilt, the last one only with a valid descriptor.
    """
    last = segments.groupBy("session_id").agg(F.max("segment_index").alias("last_index"))
    valid = descriptors.where("valid").select("session_id", "segment_index", F.lit(True).alias("described")).distinct()
    rows = segments.where(~C("readable")).join(last, "session_id").join(valid, ["session_id", "segment_index"], "left")
    is_last = C("segment_index") == C("last_index")
    reason = F.when(~is_last, "closed_unreadable").when(C("described").isNull(), "last_without_descriptor")
    return rows.select("session_id", "segment_index", reason.alias("reason")).where("reason is not null")


def fault_archive_checks(facts: DataFrame) -> DataFrame:
    return check_rows(facts, ["session_id"], [
        ("fault-archive-clean", (C("tree_errors") == 0) & (C("segment_errors") == 0) & (C("layout_errors") == 0)),
        ("fault-archive-status", (C("status") == "faulted") & C("fault_marker")), ("fault-archive-watermarks", C("watermarks_match")),
        ("fault-archive-frames", (C("physical_frames") > 0) & (C("physical_frames") == C("committed_samples"))),
        ("fault-archive-segments", (C("segments") > 0) & (C("inexact_headers") == 0) & (C("trailing_segments") == 0))])


def replug_checks(rows: DataFrame, rate: int, required_seconds: float) -> DataFrame:
    """Order of device states and phases in replug telemetry.

    ``rows``: session_id, seq, phase, state, is_fault, captured_samples, elapsed_seconds,
    peak, exact_match, target_present, consecutive. Everything is one aggregate per
    session.
    """
    state = lambda s: C("state") == s
    a, z = C("phase") == "before", C("phase") == "after"
    first = lambda cond: F.min(F.when(cond, C("seq")))
    ends = F.struct("captured_samples", "elapsed_seconds")

    def rate_of(cond):
        lo, hi = F.min_by(ends, F.when(cond, C("seq"))), F.max_by(ends, F.when(cond, C("seq")))
        de = hi["elapsed_seconds"] - lo["elapsed_seconds"]
        return F.when(de > 0, (hi["captured_samples"] - lo["captured_samples"]) / de)

    f = rows.groupBy("session_id").agg(
        *[F.count_if(state(s)).alias(f"n_{s}") for s in ("present", "absent", "stable")],
        *[first(state(s)).alias(f"at_{s}") for s in ("present", "absent", "stable")],
        F.bool_and(F.when(state("present"), C("exact_match"))).alias("present_exact"),
        F.bool_or(F.when(state("absent"), C("target_present"))).alias("absent_present"),
        F.max(F.when(state("stable"), C("consecutive"))).alias("stable_run"),
        first(a).alias("a_first"), first(a & C("is_fault")).alias("a_fault"), first(z).alias("b_first"), F.count_if(z).alias("b_rows"),
        rate_of(a & ~C("is_fault")).alias("a_rate"), rate_of(z).alias("b_rate"),
        F.max(F.when(a, C("peak"))).alias("a_peak"), F.max(F.when(z, C("peak"))).alias("b_peak"),
        F.max(F.when(z, C("elapsed_seconds"))).alias("b_elapsed"))
    quiet = 10 ** (-50 / 20)
    ok_rate = lambda c: C(c).between(rate * 0.95, rate * 1.05)
    return check_rows(f, ["session_id"], [
        ("replug-states-once", (C("n_present") == 1) & (C("n_absent") == 1) & (C("n_stable") == 1)),
        ("replug-present-exact", C("present_exact") & (C("at_present") < C("a_first"))), ("replug-absent", ~C("absent_present")),
        ("replug-fault-before-absent", C("a_fault") < C("at_absent")), ("replug-stable", (C("at_absent") < C("at_stable")) & (C("stable_run") >= 2)),
        ("replug-after-stable", (C("b_rows") >= 2) & (C("b_first") > C("at_stable"))), ("replug-rates", ok_rate("a_rate") & ok_rate("b_rate")),
        ("replug-levels", (C("a_peak") > quiet) & (C("b_peak") > quiet)), ("replug-duration", C("b_elapsed") >= required_seconds)])
