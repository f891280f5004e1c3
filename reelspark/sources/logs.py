"""Application and session logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelspark.functions import documents as d
from reelspark.functions import text as t

C = F.col
CAPACITY = 2000


def parse_log(lines: DataFrame) -> DataFrame:
    """Entries from JSON lines (store, text); incomplete ones are dropped, others defaulted.

    category, event and message are cut for display; the full ones stand beside them.
    """
    rows = d.parse_rows(lines, "text", "e")
    e = C("e")
    said = lambda n: F.when(d.is_text(e, f"$.{n}") & (F.trim(d.text(e, f"$.{n}")) != ""), d.text(e, f"$.{n}"))
    one_of = lambda n, known, default: F.coalesce(F.when(said(n).isin(*known), said(n)), F.lit(default))
    ok = said("event").isNotNull() & d.is_text(e, "$.message") & d.is_positive(e, "$.seq") & said("ts").isNotNull()
    full_category, full_event, full_message = F.coalesce(F.trim(said("category")), F.lit("app")), F.trim(said("event")), d.text(e, "$.message")
    return rows.where(F.coalesce(ok, F.lit(False))).select(
        "store", d.whole(e, "$.seq").alias("seq"), said("ts").alias("ts"),
        one_of("level", t.LEVELS, "info").alias("level"), one_of("source", t.SOURCES, "ui").alias("source"),
        F.substring(full_category, 1, t.CATEGORY_CAP).alias("category"), F.substring(full_event, 1, t.EVENT_CAP).alias("event"),
        t.clamp(full_message, t.MESSAGE_CAP).alias("message"), full_category.alias("full_category"), full_event.alias("full_event"), full_message.alias("full_message"),
        F.trim(said("session_id")).alias("session_id"),
        F.when(d.is_object(e, "$.data"), d.text(e, "$.data")).alias("data"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path).select(C("_metadata.file_path").alias("store"), C("value").alias("text")))


def newest(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The newest entries per store; the rank limit already applies before the shuffle."""
    w = Window.partitionBy("store").orderBy(F.desc("seq"))
    return entries.withColumn("rn", F.row_number().over(w)).where(C("rn") <= capacity).drop("rn")


def kept_and_dropped(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    n = entries.groupBy("store").agg(F.count(F.lit(1)).alias("n"))
    return n.select("store", F.least(C("n"), F.lit(capacity).cast("long")).alias("kept"), F.greatest(C("n") - capacity, F.lit(0).cast("long")).alias("dropped"))


def search(entries: DataFrame, level: str, needle: str) -> DataFrame:
    """Entries at or above a level (all, warn, error) that contain the text anywhere, also behind what is shown."""
    levels = {"all": t.LEVELS, "warn": ("warn", "error"), "error": ("error",)}[level]
    hay = F.lower(F.concat_ws(" ", "ts", "level", "source", "full_category", "full_event", "full_message", F.coalesce("session_id", F.lit("")), F.coalesce("data", F.lit(""))))
    return entries.where(C("level").isin(*levels) & F.contains(hay, F.lit(needle.lower())))


def union_stores(app: DataFrame, session: DataFrame) -> DataFrame:
    return app.unionByName(session, allowMissingColumns=True)


def log_line() -> Column:
    """Text form of an entry."""
    return F.concat_ws("  ", "ts", F.rpad(F.upper("level"), 5, " "), F.concat_ws("/", "source", "category"), "event", "message",
                       F.when(C("session_id").isNotNull(), F.concat(F.lit("session="), C("session_id"))),
                       F.when(C("data") != "{}", C("data")))
