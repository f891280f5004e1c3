"""Recording folders below a root, found from file names alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col
# A child that makes a folder a recording.
SIGNS = ("session.json", "metadata", "audio")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modified_at; file contents are pruned from the scan.

    Spark's file sources pass over files without a byte, so these aren't listed.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return f.select("path", "length", C("modificationTime").alias("modified_at"))


def recording_scan(files: DataFrame, root: str) -> DataFrame:
    """Recordings among the folders directly below ``root``.

    The newest metadata file dates a recording; files deeper in audio do not.
    """
    rest = F.substring(C("path"), len(root.rstrip("/")) + 2, 2_000_000)
    rows = files.where(C("path").startswith(root.rstrip("/") + "/")).select("length", "modified_at", F.split(rest, "/").alias("p")).where(F.size("p") >= 2)
    child = C("p")[1]
    sign = F.when(F.size("p") == 2, child == "session.json").otherwise(child.isin("metadata", "audio"))
    rows = rows.select(C("p")[0].alias("session_dir"), child.alias("child"), sign.alias("sign"), F.size("p").alias("depth"), "length", "modified_at")
    dated = (C("depth") == 2) | (C("child") == "metadata")
    out = rows.groupBy("session_dir").agg(
        F.bool_or("sign").alias("is_recording"), F.coalesce(F.max(F.when(dated, C("modified_at"))), F.max("modified_at")).alias("modified_at"),
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.bool_or(C("child") == "metadata").alias("has_metadata"))
    issue = F.when(~C("has_metadata"), "no_metadata")
    return out.where("is_recording").select("session_dir", "modified_at", "files", "bytes", issue.alias("issue"))
