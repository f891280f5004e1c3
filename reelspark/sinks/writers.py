"""Sinks. Each writes in parallel; only line order across files is fixed by the file names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.fleet import manifest
from reelspark.sources.logs import CAPACITY, log_line, newest

C = F.col


def write_delivery_csv(lines: DataFrame, path: str, lines_per_part: int = 1_000_000) -> None:
    """One file per session and part of its table; the parts in order are the CSV, header first.

    ``lines``: session_id, line_no, line, see ``operators.delivery.csv_lines``.
    """
    part = F.floor(C("line_no") / lines_per_part).cast("int").alias("part")
    rows = lines.select("session_id", part, "line_no", C("line").alias("value")).repartition("session_id", "part")
    rows.sortWithinPartitions("session_id", "part", "line_no").drop("line_no").write.mode("overwrite").partitionBy("session_id", "part").text(path)


def write_manifest_json(parts: DataFrame, path: str) -> None:
    """One file per session and part."""
    rows = parts.select("session_id", "part", C("document").alias("value")).repartition("session_id", "part")
    rows.write.mode("overwrite").partitionBy("session_id", "part").text(path)


def write_cuts(parts: DataFrame, path: str) -> None:
    """Cut samples by session; rows of a take are ordered by their part_start."""
    rows = parts.repartition("session_id", F.floor(C("part_start") / 2**24)).sortWithinPartitions("session_id", "part_start")
    rows.write.mode("overwrite").partitionBy("session_id").parquet(path)


def write_sha256(files: DataFrame, path: str) -> None:
    """Manifest lines, sorted by path over all output files; a repeated path fails the job."""
    lines = manifest(files)
    checked = F.when(C("duplicate"), F.raise_error(F.concat(F.lit("path listed twice: "), C("path")))).otherwise(C("line"))
    lines.orderBy("path").select(checked.alias("value")).write.mode("overwrite").text(path)


def write_log_text(entries: DataFrame, path: str) -> None:
    entries.orderBy("store", "seq").select(log_line().alias("value")).write.mode("overwrite").text(path)


def write_report(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_states(states: DataFrame, path: str) -> None:
    """Newest states, a folder per session. Folders of the sessions at hand are replaced, all others stay."""
    rows = states.repartition("session_dir").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    rows.partitionBy("session_dir").parquet(path)


def rewrite_logs(entries: DataFrame, path: str, capacity: int = CAPACITY) -> None:
    """Logs cut to their newest entries, a folder per store; ``entries`` must not be read from ``path`` itself."""
    rows = newest(entries, capacity).repartition("store").sortWithinPartitions("store", "seq")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store").json(path)
