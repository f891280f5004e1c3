"""Health of a recording from its polled rows.

Rows carry ``session_id``, ``seq`` (unique, rising) and the meter columns. Running values
go through ``scan``; first and last rows are ``min_by``/``max_by`` aggregates, which
combine map-side, so no operator orders a whole session in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import levels
from reelspark.operators.scan import Scan, chunk_of, scan
from reelspark.session import written

C = F.col
KEYS = ["session_id"]


def chunked(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("chunk", chunk_of("seq", width))


def fault_row() -> Column:
    return C("faulted") | (C("overflow_samples") > 0) | C("fault_marker_exists")


def with_previous(rows: DataFrame, width: int, *names: str) -> DataFrame:
    """Adds ``prev_<name>`` and ``has_prev``."""
    spec = Scan(lag={"has_prev": F.lit(True), **{f"prev_{n}": C(n) for n in names}})
    out = scan(chunked(rows, width), KEYS, ["seq"], "chunk", spec)
    return out.withColumn("has_prev", F.coalesce("has_prev", F.lit(False)))


def monotonic(rows: DataFrame, width: int) -> DataFrame:
    names = {"captured_samples": "captured_monotonic", "committed_samples": "committed_monotonic",
             "segment_total_bytes": "file_bytes_monotonic"}
    rows = with_previous(rows, width, *names)
    return rows.groupBy(*KEYS).agg(*[
        F.bool_and(~C("has_prev") | (C(n) >= C(f"prev_{n}"))).alias(out) for n, out in names.items()])


def growth_stalls(rows: DataFrame, width: int) -> DataFrame:
    """Adds ``stall_seconds``: time since the last byte growth while capture advanced."""
    rows = with_previous(rows, width, "captured_samples", "committed_samples", "segment_total_bytes")
    grew = F.when(C("has_prev"), C("segment_total_bytes") > C("prev_segment_total_bytes")).otherwise(C("segment_total_bytes") > 0)
    rows = rows.withColumn("grew", grew)
    rows = scan(rows, KEYS, ["seq"], "chunk", Scan(last={"grew_before": F.when(C("grew"), C("elapsed_seconds"))}))
    last_growth = F.when(C("grew"), C("elapsed_seconds")).otherwise(C("grew_before"))
    advancing = C("has_prev") & (C("captured_samples") > C("prev_captured_samples"))
    return rows.withColumn("stall_seconds", F.when(advancing, C("elapsed_seconds") - last_growth))


def progress_summary(rows: DataFrame, rate: int, poll_seconds: float, width: int) -> DataFrame:
    """One row per session with every telemetry measure of the acceptance rules."""
    rows = growth_stalls(rows, width)
    ends = F.struct("captured_samples", "elapsed_seconds")
    fault = fault_row()
    critical = C("storage_status") == "critical"
    zero = F.lit(0).cast("long")
    out = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.bool_and(~C("has_prev") | (C("captured_samples") >= C("prev_captured_samples"))).alias("captured_monotonic"),
        F.bool_and(~C("has_prev") | (C("committed_samples") >= C("prev_committed_samples"))).alias("committed_monotonic"),
        F.bool_and(~C("has_prev") | (C("segment_total_bytes") >= C("prev_segment_total_bytes"))).alias("file_bytes_monotonic"),
        F.coalesce(F.max("stall_seconds"), F.lit(0.0)).alias("max_file_growth_stall_seconds"),
        F.max(F.greatest(zero, C("captured_samples") - C("committed_samples"))).alias("max_commit_lag_samples"),
        F.greatest(F.lit(0.0), F.max("peak")).alias("maximum_peak"),
        F.greatest(F.lit(0.0), F.max("rms")).alias("maximum_rms"),
        F.min_by(ends, "seq").alias("first"), F.max_by(ends, "seq").alias("last"),
        F.min(F.when(fault, C("seq"))).alias("first_fault_seq"),
        F.min(F.when(critical, C("seq"))).alias("first_critical_seq"))
    elapsed = C("last.elapsed_seconds") - C("first.elapsed_seconds")
    return out.select(
        "*", F.lit(max(10.0, poll_seconds * 3)).alias("allowed_file_growth_stall_seconds"),
        (C("max_commit_lag_samples") / F.lit(float(rate))).alias("max_commit_lag_seconds"),
        F.when(elapsed > 0, (C("last.captured_samples") - C("first.captured_samples")) / elapsed).alias("observed_capture_rate"),
        levels.linear_dbfs(C("maximum_peak")).alias("maximum_peak_dbfs"),
        levels.linear_dbfs(C("maximum_rms")).alias("maximum_rms_dbfs")).drop("first", "last")


def observed_values(rows: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values per session, one row each."""
    return rows.where(C(column).isNotNull()).select(*KEYS, C(column).alias("observed")).distinct()


def timeline_watermark(rows: DataFrame, width: int, captured: str = "captured_samples", fallback: str | None = None) -> DataFrame:
    """Adds ``timeline``: the running maximum of the capture cursor."""
    received = F.when(C(captured) >= 0, C(captured))
    if fallback:
        received = F.coalesce(received, F.when(C(fallback) >= 0, C(fallback)))
    rows = scan(chunked(rows.withColumn("received", received), width), KEYS, ["seq"], "chunk", Scan(top={"before": C("received")}))
    return rows.withColumn("timeline", F.coalesce(F.greatest("before", "received"), F.lit(0).cast("long"))).drop("before", "received", "chunk")


def first_fault(rows: DataFrame) -> DataFrame:
    """First fault row and the first one that names a kind, else the first."""
    fault = fault_row()
    named = fault & (F.trim(F.coalesce(C("fault_kind"), F.lit(""))) != "")
    row = F.struct("seq", "elapsed_seconds", "fault_kind")
    out = rows.where(fault).groupBy(*KEYS).agg(
        F.min_by(row, "seq").alias("first_fault"), F.min_by(row, F.when(named, C("seq"))).alias("named"))
    return out.select(*KEYS, "first_fault", F.coalesce("named", "first_fault").alias("first_kind"))


def stopped_after_fault(rows: DataFrame, tail_rows: int = 3) -> DataFrame:
    """Does the capture cursor stand still in the last rows after the first fault?

    Rows after the fault are a suffix of the session, so their last rows are the
    session's last rows; the row_number limit is applied before the shuffle.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("seq"))
    tail = (rows.select(*KEYS, "seq", "elapsed_seconds", "captured_samples")
            .withColumn("rn", F.row_number().over(newest)).where(C("rn") <= tail_rows))
    fault = first_fault(rows).select(*KEYS, C("first_fault.elapsed_seconds").alias("fault_elapsed"))
    after = fault.join(tail, KEYS, "left").where(C("elapsed_seconds") >= C("fault_elapsed"))
    return after.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("tail_rows"), F.count_distinct("captured_samples").alias("tail_values")).select(
        "*", ((C("tail_rows") >= 2) & (C("tail_values") == 1)).alias("stopped"))


def telemetry_rate(rows: DataFrame, rate: int, by: str = "phase") -> DataFrame:
    ends = F.struct("captured_samples", "elapsed_seconds")
    out = rows.groupBy(*KEYS, by).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(ends, "seq").alias("a"), F.max_by(ends, "seq").alias("z"))
    elapsed = C("z.elapsed_seconds") - C("a.elapsed_seconds")
    observed = F.when(elapsed > 0, (C("z.captured_samples") - C("a.captured_samples")) / elapsed)
    return out.select(*KEYS, by, "n", observed.alias("observed_rate")).select(
        "*", F.coalesce(C("observed_rate").between(rate * 0.95, rate * 1.05), F.lit(False)).alias("within"))


def armed_row(rows: DataFrame, width: int, trigger_ms: int, required: int, max_lag: int) -> DataFrame:
    """First row after the trigger that proves progressing, durable capture."""
    rows = with_previous(rows, width, "committed_samples", "segment_total_bytes")
    lag = C("captured_samples") - C("committed_samples")
    ok = ((C("at_ms") >= trigger_ms) & ~fault_row() & (C("committed_samples") >= required) & (lag >= 0) & (lag <= max_lag)
          & C("has_prev") & (C("committed_samples") > C("prev_committed_samples"))
          & (C("segment_total_bytes") > C("prev_segment_total_bytes")))
    return rows.where(ok).groupBy(*KEYS).agg(F.min_by(F.struct("seq", "captured_samples", "committed_samples"), "seq").alias("armed"))


def meter_window(rows: DataFrame, slice_ms: int) -> DataFrame:
    """Largest peak and rms per poll slice, every other meter at its newest value."""
    return rows.groupBy(*KEYS, F.floor(C("at_ms") / slice_ms).cast("long").alias("slice")).agg(
        F.max("peak").alias("peak"), F.max("rms").alias("rms"),
        F.max_by("captured_samples", "seq").alias("captured_samples"),
        F.max_by("storage_status", "seq").alias("storage_status"))


def discontinuity_streaks(rows: DataFrame, width: int, rate: int, streak_ms: int = 50, min_ms: int = 10) -> DataFrame:
    """Every increase of the discontinuity count with the silence of its streak.

    ``count``, ``silence_samples`` and ``now_ms`` are the meter columns. Only rows where
    the count moves, few among all polls, are written and reach the second and third scan.
    """
    rows = scan(chunked(rows, width), KEYS, ["seq"], "chunk",
                Scan(lag={"prev_count": C("count"), "prev_silence": C("silence_samples")}))
    moved = rows.where(C("prev_count").isNotNull() & (C("count") != C("prev_count"))).select(
        *KEYS, "seq", "now_ms", "chunk",
        ((C("count") > C("prev_count")) & (C("count") > 0)).alias("inc"), (C("count") < C("prev_count")).alias("dec"),
        F.greatest(F.lit(0).cast("long"), C("silence_samples") - C("prev_silence")).alias("added"))
    moved = written(moved, "moved-counts")
    moved = scan(moved, KEYS, ["seq"], "chunk", Scan(last={"last_inc": F.when(C("inc"), C("now_ms"))}))
    in_streak = F.coalesce((C("last_inc") > 0) & (C("now_ms") - C("last_inc") <= streak_ms), F.lit(False))
    moved = moved.withColumn("fresh", C("inc") & ~in_streak)
    moved = scan(moved, KEYS, ["seq"], "chunk", Scan(run={
        "before": (F.when(C("inc"), C("added")), C("fresh") | C("dec"), C("fresh"))}))
    total = F.when(C("fresh"), C("added")).otherwise(C("before") + C("added"))
    shown = F.floor(total / F.lit(float(max(1, rate))) * 1000 + 0.5)
    return moved.where("inc").select(*KEYS, "seq", total.alias("streak_silence_samples"), (shown >= min_ms).alias("show"))


def bin_batches(rows: DataFrame, width: int, bin_samples: int = 64) -> DataFrame:
    """Places live waveform packets (``n_bins``, ``end_sample``) on the sample timeline.

    Packets that end before the timeline are dropped, a gap resets it, an overlap is
    trimmed by whole bins.
    """
    start = C("end_sample") - C("n_bins") * bin_samples
    rows = rows.withColumn("start_sample", start)
    live = (C("n_bins") > 0) & (start >= 0)
    rows = scan(chunked(rows, width), KEYS, ["seq"], "chunk", Scan(top={"prev_end": F.when(live, C("end_sample"))}))
    stale = ~live | F.coalesce(C("end_sample") <= C("prev_end"), F.lit(False))
    overlap = F.greatest(F.lit(0).cast("long"), C("prev_end") - C("start_sample"))
    trim = F.least(C("n_bins"), F.ceil(overlap / F.lit(float(bin_samples))).cast("long"))
    return rows.select(
        *KEYS, "seq", "n_bins", "start_sample", "end_sample",
        F.when(stale, F.lit(0).cast("long")).otherwise(C("n_bins") - F.coalesce(trim, F.lit(0).cast("long"))).alias("kept_bins"),
        (~stale & F.coalesce(C("start_sample") > C("prev_end"), F.lit(False))).alias("reset"),
        F.coalesce(F.greatest("prev_end", F.when(live, C("end_sample"))), F.lit(0).cast("long")).alias("timeline_end"))


def take_spans(rows: DataFrame, width: int) -> DataFrame:
    """Spans of a ``recording`` flag; the end is null while the last one is open."""
    rows = scan(chunked(rows, width), KEYS, ["seq"], "chunk", Scan(lag={"was": C("recording")}))
    was = F.coalesce(C("was"), F.lit(False))
    edges = rows.where(C("recording") != was)
    edges = scan(written(edges.select(*KEYS, "seq", "chunk", "recording", "cursor"), "edges"), KEYS, ["seq"], "chunk",
                 Scan(total={"rises": C("recording").cast("long")}))
    span = C("rises") + C("recording").cast("long")
    return edges.groupBy(*KEYS, span.alias("span")).agg(
        F.min(F.when(C("recording"), C("cursor"))).alias("start_sample"),
        F.max(F.when(~C("recording"), C("cursor"))).alias("close")).select(
        *KEYS, "span", "start_sample", F.greatest("start_sample", "close").alias("_e"), "close").select(
        *KEYS, "span", "start_sample", F.when(C("close").isNotNull(), C("_e")).alias("end_sample"))


def consecutive(rows: DataFrame, width: int, matched: Column) -> DataFrame:
    """Adds ``matches``: length of the run of matching rows that ends here."""
    rows = chunked(rows.withColumn("matched", matched), width)
    rows = scan(rows, KEYS, ["seq"], "chunk", Scan(run={"before": (F.lit(1), ~C("matched"), F.lit(False))}))
    return rows.withColumn("matches", F.when(C("matched"), C("before") + 1).otherwise(F.lit(0).cast("long"))).drop("before", "chunk")
