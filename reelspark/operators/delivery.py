"""Deliveries: sentence cuts, metadata tables and the space they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import storage
from reelspark.functions.text import csv_cell, fixed6
from reelspark.operators.checks import check_rows
from reelspark.operators.scan import Scan, chunk_of, scan

C = F.col
# Columns of the delivered table, in order.
CSV_COLUMNS = ("id", "text", "label", "attempt_id", "start_sample", "recording_started_sample", "head_silence_armed_sample", "head_silence_passed_sample",
               "required_head_silence_samples", "content_started_sample", "content_started_seconds", "end_sample", "duration_samples", "file",
               "forced_without_tail_silence", "tail_silence_samples", "required_tail_silence_samples")
TEXT_COLUMNS = ("id", "text", "label", "attempt_id", "file")


def csv_line() -> Column:
    """A delivered row; text is always quoted, a bad number is 0."""
    def cell(name: str) -> Column:
        if name in TEXT_COLUMNS:
            return csv_cell(C(name))
        if name == "content_started_seconds":
            return F.coalesce(F.when(C(name) >= 0, fixed6(name)), F.lit("0.000000"))
        if name == "forced_without_tail_silence":
            return F.coalesce(C(name), F.lit(False)).cast("string")
        return F.when(C(name) >= 0, C(name).cast("string")).otherwise("0")

    return F.concat_ws(",", *[cell(c) for c in CSV_COLUMNS])


def csv_lines(rows: DataFrame, width: int) -> DataFrame:
    """Lines of each session's table (session_id, line_no, line): the header, then the rows in item order.

    ``pos`` is the item's place in the snapshot (unique, with gaps where nothing is delivered); ids are text.
    """
    numbered = scan(rows.withColumn("chunk", chunk_of("pos", width)), ["session_id"], ["pos"], "chunk", Scan(total={"before": F.lit(1).cast("long")}))
    lines = numbered.select("session_id", (C("before") + 1).alias("line_no"), csv_line().alias("line"))
    head = rows.select("session_id").distinct().select("session_id", F.lit(0).cast("long").alias("line_no"), F.lit(",".join(CSV_COLUMNS)).alias("line"))
    return head.unionAll(lines)


def sentence_file(order: Column, item: Column) -> Column:
    return F.concat(F.lit("sentences/"), F.lpad(order.cast("string"), 6, "0"), F.lit("-"), item.cast("string"), F.lit(".wav"))


def cut_parts(takes: DataFrame, blocks: DataFrame, frames_per_block: int) -> DataFrame:
    """Sample slices of each take, one row per touched block.

    Blocks of one length make the range join an equi join on the block number. A take is
    kept as ordered parts, never gathered into one array.
    """
    first = F.floor(C("start_sample") / frames_per_block).cast("long")
    last = F.floor((C("end_sample") - 1) / frames_per_block).cast("long")
    t = takes.where("end_sample > start_sample").select("*", F.explode(F.sequence(first, last)).alias("block"))
    bl = blocks.select("session_id", F.floor(C("block_start") / frames_per_block).cast("long").alias("block"), "block_start", "block_end", "samples")
    j = t.join(bl, ["session_id", "block"])
    lo, hi = F.greatest("start_sample", "block_start"), F.least("end_sample", "block_end")
    part = F.slice("samples", (lo - C("block_start") + 1).cast("int"), (hi - lo).cast("int"))
    return j.where(hi > lo).select(*takes.columns, "block", lo.alias("part_start"), part.alias("samples"))


def cut_totals(takes: DataFrame, parts: DataFrame, keys: list[str], bit_depth: int) -> DataFrame:
    """Frames and planned file of every take; one that is empty or not covered has an error and no file."""
    n = parts.groupBy(*keys).agg(F.sum(F.size("samples")).alias("frames"))
    out = takes.select(*keys, (C("end_sample") - C("start_sample")).alias("wanted")).join(n, keys, "left").withColumn("frames", F.coalesce("frames", F.lit(0).cast("long")))
    error = F.when(C("wanted") <= 0, "empty_range").when(C("frames") != C("wanted"), "not_covered")
    out = out.select("*", error.alias("error"), storage.wav_plan(C("frames"), F.lit(1), F.lit(bit_depth)).alias("p"))
    return out.select(*keys, "frames", "error", *[F.when(C("error").isNull(), C(f"p.{c}")).alias(c) for c in ("container", "file_bytes")])


def export_peak(steps: DataFrame, width: int, critical_reserve: int) -> DataFrame:
    """Largest extra space of an export whose steps replace old files one after another.

    ``steps``: export_id, step, new_bytes, replaced_bytes, available_bytes. A replaced file
    is only freed after its successor is published.
    """
    rows = scan(steps.withColumn("chunk", chunk_of("step", width)), ["export_id"], ["step"], "chunk",
                Scan(total={"published": C("new_bytes"), "reclaimed": C("replaced_bytes")}))
    extra = F.greatest(F.lit(0).cast("long"), C("published") + C("new_bytes") - C("reclaimed"))
    out = rows.groupBy("export_id").agg(F.max(extra).alias("peak_additional_bytes"), F.max("available_bytes").alias("available"))
    need = C("peak_additional_bytes") + critical_reserve
    return out.select("export_id", "peak_additional_bytes", need.alias("required_available_bytes"), (C("available") >= need).alias("can_export"))


def manifest_parts(rows: DataFrame, sources: DataFrame, items_per_part: int) -> DataFrame:
    """Delivery metadata as JSON parts of at most ``items_per_part`` rows each.

    ``rows``: session_id, pos (the item's place in the snapshot), item_id (text), attempt_id, exported; ``sources``:
    session_id, journal_seq, committed_samples of the state that is delivered. Each part names
    its source; a session's parts in order are its ``exported``, ``skipped`` and
    ``selected_attempts`` lists, and no part grows with the session.
    """
    entry = F.struct("pos", C("item_id").alias("id"), "attempt_id")
    part = chunk_of("pos", items_per_part)
    out = rows.groupBy("session_id", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.when(C("exported"), entry))).alias("exported"),
        F.array_sort(F.collect_list(F.when(~C("exported"), entry))).alias("skipped"),
        F.array_sort(F.collect_list(entry)).alias("selected_attempts"))
    out = out.join(sources.select("session_id", "journal_seq", "committed_samples"), "session_id", "left")
    source = F.struct("journal_seq", "committed_samples", "selected_attempts").alias("source")
    return out.select("session_id", "part", F.size("exported").alias("n_exported"), F.size("skipped").alias("n_skipped"),
                      F.to_json(F.struct(source, "exported", "skipped")).alias("document"))


def manifest_checks(facts: DataFrame) -> DataFrame:
    """Do status, metadata, table and cuts of a delivery belong to the same generation?"""
    return check_rows(facts, ["session_id"], [
        ("manifest-status", (C("bundle_version") == 2) & (C("bundle_status") == "complete") & (C("bundle_session_id") == C("session_id"))),
        ("manifest-source", (C("source_seq") == C("journal_seq")) & (C("source_committed") == C("committed_samples")) & C("selections_equal")),
        ("manifest-counts", (C("exported") + C("skipped") == C("total_items")) & (C("status_exported") == C("exported"))),
        ("manifest-files", C("names_equal"))])
