"""History page: from persisted candidates to one page of session rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.operators import rules, sessions
from reelspark.sources import recordings, snapshots

C = F.col
# Fixed values.
DEFAULT_LIMIT, MAX_LIMIT = 100, 200


def page_directories(directories: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Newest directories first, cut before any state is read.

    Sort, offset and limit together run as a top-k, each task keeps offset + limit rows;
    for pages far back see ``page_after``.
    """
    if not 1 <= limit <= MAX_LIMIT or offset < 0:
        raise ValueError("offset must be >= 0 and limit within 1..200")
    return directories.orderBy(F.desc("modified_at"), "session_dir").offset(offset).limit(limit)


def page_after(directories: DataFrame, last: tuple | None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The page behind ``last`` (modified_at, session_dir), the final row of the page before.

    Each task keeps ``limit`` rows however far the reader has paged.
    """
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError("limit must be within 1..200")
    if last is not None:
        at, name = F.lit(last[0]), F.lit(last[1])
        directories = directories.where((C("modified_at") < at) | ((C("modified_at") == at) & (C("session_dir") > name)))
    return directories.orderBy(F.desc("modified_at"), "session_dir").limit(limit)


def page_totals(directories: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    n = directories.agg(F.count(F.lit(1)).alias("total_directories"))
    end = F.least(C("total_directories"), F.lit(offset + limit).cast("long"))
    return n.select("total_directories", F.greatest(F.lit(0).cast("long"), end - offset).alias("scanned_directories"),
                    F.when(end < C("total_directories"), end).alias("next_offset"))


def history_page(candidates: DataFrame, markers: DataFrame, items: DataFrame, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One page of history rows, newest first.

    Only the page's directories are joined with candidates and items; the page has at
    most 200 rows, a proven bound for its broadcast. A directory whose sources name several
    sessions stays on the page for inspection: no trusted state, status ``invalid``.
    """
    directories = candidates.groupBy("session_dir").agg(F.max("modified_at").alias("modified_at"))
    return page_rows(page_directories(directories, offset, limit), candidates, markers, items)


def page_from_files(spark: SparkSession, root: str, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The page of a root of recording folders, read from their files.

    Names and times of all files are listed; snapshots and journals are opened for the folders of
    the page only, MAX_LIMIT at most. A folder without usable or agreeing state keeps its row.
    """
    plain = re.sub("^file:/*(?=/)", "", root.rstrip("/"))
    listing = recordings.list_files(spark, root).withColumn("path", F.regexp_replace("path", "^file:/*(?=/)", ""))
    found = recordings.recording_scan(listing, plain).withColumn("session_dir", F.concat(F.lit(f"{plain}/"), "session_dir"))
    page = page_directories(found.select("session_dir", "modified_at", "issue"), offset, limit)
    rows = page.collect()
    page = spark.createDataFrame(rows, page.schema)
    folders = [f"{r['session_dir']}/metadata" for r in rows if r["issue"] is None]
    marker = F.element_at(F.split("path", "/"), -1)
    markers = listing.select(snapshots.folder_of(C("path")).alias("session_dir"), marker.alias("name"), "modified_at").where(C("name").startswith("audio-fault."))
    if folders:
        candidates = snapshots.candidate_rows(snapshots.read_snapshot_files(spark, folders), snapshots.read_journals(spark, folders))
    else:
        kinds = "session_dir string, session_id string, journal_seq long, priority int, ordinal long, modified_at timestamp, status string, overflow_samples long, committed_samples long, captured_samples long, item_statuses array<string>"
        candidates = spark.createDataFrame([], kinds)
    items = sessions.latest_snapshot(candidates).select(C("session_dir").alias("session_id"), F.explode("item_statuses").alias("status"))
    return page_rows(page, candidates, markers, items)


def page_rows(directories: DataFrame, candidates: DataFrame, markers: DataFrame, items: DataFrame) -> DataFrame:
    """History rows of the listed directories (session_dir, modified_at), MAX_LIMIT at most."""
    listed = F.broadcast(directories.select("session_dir", C("modified_at").alias("listed_at")))
    page = listed.select("session_dir")
    latest = sessions.latest_snapshot(candidates.join(page, "session_dir", "left_semi"))
    marked = sessions.fault_override(latest, markers.join(page, "session_dir", "left_semi"))
    counts = sessions.item_counts(items.join(page.withColumnRenamed("session_dir", "session_id"), "session_id", "left_semi"))
    counts = counts.withColumnRenamed("session_id", "session_dir")
    found = listed.join(marked.join(counts, "session_dir", "left"), "session_dir", "left")
    issue = C("session_id").isNull()
    zero = ["captured_samples", "committed_samples", "overflow_samples", *[f"{s}_items" for s in ("total", *sessions.STATUSES)]]
    rows = found.select(
        "session_dir", F.coalesce("session_id", F.element_at(F.split(C("session_dir").cast("string"), "/"), -1)).alias("session_id"), issue.alias("history_issue"),
        F.coalesce("status", F.lit("invalid")).alias("status"), F.coalesce("modified_at", "listed_at").alias("modified_at"), "journal_seq", F.coalesce("fault_marker", F.lit(False)).alias("fault_marker"),
        *[F.when(~issue, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c) for c in zero])
    rows = rows.withColumn("is_active", F.lit(False))
    rows = rows.withColumn("kind", rules.session_kind()).withColumn("data_health", F.when(~C("history_issue"), rules.data_health()))
    return rows.select(
        "session_dir", "session_id", "status", "kind", "data_health", "history_issue", "journal_seq", "captured_samples", "committed_samples",
        "overflow_samples", "modified_at", "total_items", *[f"{s}_items" for s in sessions.STATUSES]).orderBy(F.desc("modified_at"), "session_dir")
