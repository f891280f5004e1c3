"""State and history of sessions: snapshots, items, takes and deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import samples as fs
from reelspark.operators.scan import Scan, chunk_of, scan

C = F.col


# --- candidates and the latest state -------------------------------------------------

def identity(candidates: DataFrame, identity_files: DataFrame | None = None) -> DataFrame:
    """Trusted session id per directory: only where every persisted source agrees.

    Smallest and largest id decide agreement, so no directory gathers its ids.
    """
    ids = candidates.select("session_dir", "session_id")
    if identity_files is not None:
        ids = ids.unionByName(identity_files.select("session_dir", "session_id"))
    out = ids.groupBy("session_dir").agg(F.min("session_id").alias("lo"), F.max("session_id").alias("hi"))
    return out.select("session_dir", F.when(C("lo") == C("hi"), C("lo")).alias("trusted_id"), (C("lo") != C("hi")).alias("conflict"))


def conflicting_ids(candidates: DataFrame) -> DataFrame:
    """Every id of the directories that do not agree, one row each."""
    ids = candidates.select("session_dir", "session_id").distinct()
    conflicts = identity(candidates).where("conflict").select("session_dir")
    return ids.join(conflicts, "session_dir", "left_semi")


def latest_snapshot(candidates: DataFrame) -> DataFrame:
    """Newest candidate per directory by (journal_seq, priority, ordinal).

    One aggregation answers both questions: the ids agree iff the smallest equals the
    largest, and then the newest of all is the newest of the trusted ones.
    """
    others = [c for c in candidates.columns if c not in ("session_dir", "session_id")]
    rank = F.struct("journal_seq", "priority", "ordinal")
    out = candidates.groupBy("session_dir").agg(
        F.min("session_id").alias("session_id"), F.max("session_id").alias("_hi"),
        F.max_by(F.struct(*others), rank).alias("s"))
    return out.where("session_id = _hi").select("session_dir", "session_id", "s.*")


def newest_evidence(markers: DataFrame) -> DataFrame:
    return markers.where(C("name").isin("audio-fault.json", "audio-fault.tmp")).groupBy("session_dir").agg(
        F.max("modified_at").alias("marker_modified_at"))


def fault_override(latest: DataFrame, markers: DataFrame) -> DataFrame:
    """A marker file makes the session faulted whatever its snapshot says."""
    out = latest.join(newest_evidence(markers), "session_dir", "left")
    marked = C("marker_modified_at").isNotNull()
    return out.withColumn("fault_marker", marked).withColumn("status", F.when(marked, "faulted").otherwise(C("status"))).withColumn(
        "modified_at", F.greatest("modified_at", "marker_modified_at")).drop("marker_modified_at")


# --- items ---------------------------------------------------------------------------

STATUSES = ("accepted", "skipped", "review", "pending")


def item_counts(items: DataFrame, key: str = "session_id") -> DataFrame:
    return items.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_items"), *[F.count_if(C("status") == s).alias(f"{s}_items") for s in STATUSES])


def script_left_state(script: DataFrame, state: DataFrame) -> DataFrame:
    """Script items with their state; an item never touched is pending."""
    return script.join(state.select("session_id", "item_id", "status"), ["session_id", "item_id"], "left").withColumn(
        "status", F.coalesce("status", F.lit("pending")))


def handled() -> Column:
    return C("status").isin("accepted", "skipped")


def capture_exit(items: DataFrame, faults: DataFrame) -> DataFrame:
    """fault, complete or pause per session; complete needs items, all of them handled."""
    done = items.groupBy("session_id").agg(F.bool_and(handled()).alias("all_handled"))
    out = faults.join(done, "session_id", "left").withColumn("all_handled", F.coalesce("all_handled", F.lit(False)))
    return out.withColumn("exit", F.when(C("faulted"), "fault").when(C("all_handled"), "complete").otherwise("pause"))


def next_actionable(items: DataFrame, width: int) -> DataFrame:
    """For each item the position to continue with after it, and how.

    Scanned backwards: the next open item behind this one, else the session's first.
    """
    is_open = C("status").isin("pending", "review")
    rows = items.select("session_id", "pos", "status", (-C("pos")).alias("back"))
    rows = scan(rows.withColumn("chunk", chunk_of("back", width)), ["session_id"], ["back"], "chunk", Scan(
        last={"after": F.when(is_open, F.struct("pos", "status"))}))
    first = items.groupBy("session_id").agg(
        F.min_by(F.struct("pos", "status"), F.when(is_open, C("pos"))).alias("first"),
        F.bool_and(handled()).alias("all_handled"))
    target = F.coalesce("after", "first")
    return rows.join(first, "session_id").select(
        "session_id", "pos", target["pos"].alias("next_pos"),
        F.when(target["status"] == "pending", "start").when(target["status"] == "review", "review")
        .when(C("all_handled"), "finish").otherwise("blocked").alias("continuation"))


def resume_position(items: DataFrame, hints: DataFrame) -> DataFrame:
    """Where to resume: the active item, else the kept one, else the first open, else 0.

    ``hints`` has active_pos and keep_pos per session; a position that does not exist is ignored.
    """
    h = hints.select("session_id", "active_pos", "keep_pos")
    out = items.join(h, "session_id").groupBy("session_id").agg(
        F.max(F.when(C("pos") == C("active_pos"), C("pos"))).alias("a"), F.max(F.when(C("pos") == C("keep_pos"), C("pos"))).alias("k"),
        F.min(F.when(C("status").isin("pending", "review"), C("pos"))).alias("n"))
    return out.select("session_id", F.coalesce("a", "k", "n", F.lit(0).cast("long")).alias("resume_pos"))


def final_review(items: DataFrame) -> DataFrame:
    """Items in review while every other one of the session is handled.

    Then it is the only unhandled one, so two counts per session decide.
    """
    per = items.groupBy("session_id").agg(
        F.count_if(~handled()).alias("open"), F.max(F.when(C("status") == "review", C("pos"))).alias("pos"))
    return per.where((C("open") == 1) & C("pos").isNotNull()).select("session_id", "pos")


# --- takes ---------------------------------------------------------------------------

def chosen_take(takes: DataFrame, items: DataFrame) -> DataFrame:
    """The selected take of an item if usable, else its last usable one.

    ``items`` has item_id and selected_attempt_id; takes are ordered by ``pos``. Two
    ordered aggregates per item replace a window over its takes.
    """
    fields = [c for c in takes.columns if c not in ("item_id", "pos")]
    take = F.struct("pos", *fields)
    usable = fs.usable_take(C("status"), C("start_sample"), C("end_sample"))
    rows = takes.withColumn("usable", usable).join(items.select("item_id", "selected_attempt_id"), "item_id", "left")
    is_selected = F.coalesce(C("attempt_id") == C("selected_attempt_id"), F.lit(False))
    out = rows.groupBy("item_id").agg(
        F.min_by(F.struct(take.alias("t"), "usable"), F.when(is_selected, C("pos"))).alias("selected"),
        F.max_by(take, F.when(C("usable"), C("pos"))).alias("latest"))
    pick = F.when(F.coalesce(C("selected.usable"), F.lit(False)), C("selected.t")).otherwise(C("latest"))
    return out.select("item_id", pick.alias("take")).where("take is not null")


def silence_marks(chosen: DataFrame, items: DataFrame, rate: int, required_ms: int, detector: str = "energy") -> DataFrame:
    """Short head or tail of the chosen take; only items in review or accepted are marked."""
    t = lambda n: C(f"take.{n}")
    start = fs.head_start(F.lit(detector), t("start_sample"), t("recording_started_sample"), t("head_silence_passed_sample"), t("required_head_silence_samples"))
    r = F.lit(rate)
    head = fs.head_silence_ms(start, t("content_started_sample"), r)
    tail = F.when(t("tail_silence_samples").isNotNull(), fs.samples_to_ms(t("tail_silence_samples"), r))
    rows = items.where(C("status").isin("review", "accepted")).select("item_id", *([] if "session_id" not in items.columns else ["session_id"]))
    rows = rows.join(chosen, "item_id", "left").withColumn("head_ms", head).withColumn("tail_ms", tail)
    need = F.lit(required_ms)
    forced = F.coalesce(t("forced_without_tail_silence"), F.lit(False))
    return rows.withColumn("head_short", fs.is_short(C("head_ms"), need)).withColumn(
        "tail_short", forced | fs.is_short(C("tail_ms"), need)).drop("take")


def flagged_takes(marks: DataFrame) -> DataFrame:
    return marks.groupBy("session_id").agg(F.count_if(C("head_short") | C("tail_short")).alias("flagged_items"))


def reconcile(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Did a timed-out stop add exactly one take, or none, with the next journal number?

    Both sides hold takes (keys, attempt_id, fingerprint) and carry journal_seq. Rows are
    compared by join, so no item gathers its takes.
    """
    b = before.select(*keys, "attempt_id", C("fingerprint").alias("was"), C("journal_seq").alias("seq_before"))
    a = after.select(*keys, "attempt_id", C("fingerprint").alias("now"), C("journal_seq").alias("seq_after"))
    out = b.join(a, [*keys, "attempt_id"], "full").groupBy(*keys).agg(
        F.max("seq_before").alias("seq_before"), F.max("seq_after").alias("seq_after"),
        F.count_if(C("was").isNull()).alias("added"), F.count_if(C("now").isNull()).alias("removed"),
        F.count_if(C("was") != C("now")).alias("changed"))
    proven = (C("seq_after") == C("seq_before") + 1) & (C("removed") == 0) & (C("changed") == 0)
    return out.select(*keys, "added", "removed", "changed", F.coalesce(
        F.when(proven & (C("added") == 1), "take_added").when(proven & (C("added") == 0), "discarded"), F.lit("unproven")).alias("outcome"))


def interrupted_takes(started: DataFrame, stopped: DataFrame, durable: DataFrame) -> DataFrame:
    """Takes begun but never stopped end at the durable frames of their session.

    started/stopped: session_id, attempt_id, seq (and start_sample); durable: session_id,
    status, journal_seq, physical_frames. A stopped session is left alone, so a second run
    changes nothing.
    """
    s = stopped.groupBy("session_id", "attempt_id").agg(F.max("seq").alias("stop_seq"))  # a start is stopped if the last stop comes after it
    live = durable.where("status != 'stopped'")
    cond = (started["session_id"] == s["session_id"]) & (started["attempt_id"] == s["attempt_id"]) & (s["stop_seq"] > started["seq"])
    return started.join(s, cond, "left_anti").join(live, "session_id").select(
        "session_id", "attempt_id", "start_sample", C("physical_frames").alias("end_sample"), F.lit("interrupted").alias("take_status"),
        F.lit("stopped").alias("session_status"), C("physical_frames").alias("captured_samples"), (C("journal_seq") + 1).alias("journal_seq"))


# --- deliveries ----------------------------------------------------------------------

def selections_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per session: do two ordered selections (session_id, pos, item_id, attempt_id) agree?"""
    l = left.select("session_id", "pos", F.struct("item_id", "attempt_id").alias("l"))
    r = right.select("session_id", "pos", F.struct("item_id", "attempt_id").alias("r"))
    return l.join(r, ["session_id", "pos"], "full").groupBy("session_id").agg(
        F.bool_and(C("l").eqNullSafe(C("r"))).alias("selections_equal"))


def export_state(snapshots: DataFrame, documents: DataFrame, selections: DataFrame) -> DataFrame:
    """never, failed, current or stale per (session, artifact).

    ``documents``: one row per status document with session_id, artifact, readable,
    schema_version, doc_session_id, doc_artifact, doc_status, source_seq,
    source_committed, source_provenance and output_exists.
    """
    out = snapshots.join(documents, "session_id", "left").join(selections, "session_id", "left")
    matches_session = ((C("schema_version") == 2) & (C("doc_session_id") == C("session_id")) & (C("doc_artifact") == C("artifact")))
    committed = C("source_committed").eqNullSafe(C("committed_samples"))
    same = F.when(C("artifact") == "full_track", committed & C("source_provenance").eqNullSafe(C("provenance"))).otherwise(
        committed & C("source_seq").eqNullSafe(C("journal_seq")) & F.coalesce("selections_equal", F.lit(True)))
    yes = lambda c: F.coalesce(c, F.lit(False))
    state = (F.when(C("readable").isNull(), "never").when(~C("readable"), "failed").when(~yes(matches_session), "failed")
             .when(~yes(C("doc_status") == "complete"), "failed").when(~yes(C("output_exists")), "failed")
             .when(same, "current").otherwise("stale"))
    return out.withColumn("state", state)


def complete_export(snapshots: DataFrame, bundles: DataFrame, files: DataFrame, outputs: tuple[str, ...], selections: DataFrame) -> DataFrame:
    """Sessions whose whole bundle is safely delivered from the present state."""
    have = files.where(C("name").isin(*outputs)).groupBy("session_id").agg(F.count_distinct("name").alias("n")).where(C("n") == len(outputs))
    out = snapshots.join(bundles, "session_id").join(selections, "session_id", "left").join(have, "session_id", "left_semi")
    ok = ((C("status") == "stopped") & ~C("fault_marker") & (C("overflow_samples") == 0)
          & (C("bundle_version") == 2) & (C("bundle_status") == "complete") & (F.trim(C("export_id")) != "")
          & (C("bundle_session_id") == C("session_id")) & (C("source_seq") == C("journal_seq"))
          & (C("source_committed") == C("committed_samples")) & F.coalesce("selections_equal", F.lit(True)))
    return out.where(ok).select("session_id")


def compact(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Newest projection per session; the previous state takes part as one more event."""
    rows = events if state is None else events.unionByName(state)
    others = [c for c in rows.columns if c != "session_id"]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*others), "journal_seq").alias("s")).select("session_id", "s.*")
