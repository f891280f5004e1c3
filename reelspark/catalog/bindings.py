"""Capture tables derived from the given tables, once for Spark and once as SQL.

Each ``name(spark, sf)`` has a twin in ``SQL`` that derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1_704_067_200_000_000  # 2024-01-01, start of the events table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def with_tables(names: str, body: str) -> str:
    """``WITH`` the named twins (and what they need) in front of ``body``."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for dep in NEEDS.get(name, ()):
            want(dep)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        want(name)
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({SQL[n]})" for n in wanted)
    glue = "\n" if body.upper().startswith("SELECT") else ",\n"
    return f"WITH {ctes}{glue}{body}"


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone is."""
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01")).cast("long")
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return ((day * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60_000_000 + second


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """One polled row per event: session = user, order = event id."""
    e = table(spark, sf, "events")
    t_ms = F.floor((micros(F.col("ts")) - F.lit(EPOCH_US)) / F.lit(1000)).cast("long")
    e = e.select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), t_ms.alias("at_ms"),
        F.col("event_type").alias("phase"), F.col("value"), F.col("props"),
        F.get_json_object("props", "$.k").cast("int").alias("k"))
    error = F.col("phase") == "error"
    captured = F.greatest(F.lit(0), F.col("at_ms") * 48 - F.when(F.col("k") == 0, F.lit(4_000_000_000)).otherwise(F.lit(0)))
    e = e.withColumn("captured_samples", captured.cast("long"))
    return e.select(
        "*",
        (F.col("at_ms") / F.lit(1000.0)).alias("elapsed_seconds"),
        F.greatest(F.lit(0).cast("long"), F.col("captured_samples") - F.floor(F.col("value") * 2400).cast("long")).alias("committed_samples"),
        F.when(error & (F.col("k") >= 95), F.col("k")).otherwise(0).cast("long").alias("overflow_samples"),
        (error & (F.col("k") < 60)).alias("faulted"),
        F.when(error, F.when(F.col("k") % 3 == 0, "").when(F.col("k") % 3 == 1, "device_unavailable").otherwise("input_stream_error")).alias("fault_kind"),
        ((F.col("phase") == "signup") & (F.col("k") < 3)).alias("fault_marker_exists"),
        F.when(F.col("value") > 200, "critical").when(F.col("value") > 120, "warning").otherwise("healthy").alias("storage_status"),
        F.least(F.lit(1.0), F.col("value") / 100).alias("peak"),
        (F.least(F.lit(1.0), F.col("value") / 100) / 4).alias("rms"),
        (F.floor(F.col("at_ms") / F.lit(172_800_000)) * 1_000_000).cast("long").alias("segment_total_bytes"),
        (F.col("value") > 40).alias("is_speech"),
    )


def takes(spark: SparkSession, sf: str) -> DataFrame:
    """One take per line item: item = order, session = supplier."""
    li = table(spark, sf, "lineitem")
    start = (F.col("l_partkey") % 2000) * 480 + F.col("l_linenumber")
    tax = F.round(F.col("l_tax") * 100).cast("long")
    disc = F.round(F.col("l_discount") * 100).cast("long")
    qty = F.col("l_quantity").cast("long")
    li = li.select(
        "*", start.cast("long").alias("start_sample"), tax.alias("_tax"), disc.alias("_disc"), qty.alias("_qty"))
    return li.select(
        F.col("l_suppkey").alias("session_id"), F.col("l_orderkey").alias("item_id"),
        F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax").alias("pos"),
        F.concat(F.lit("a"), F.col("l_linenumber").cast("string")).alias("attempt_id"),
        "start_sample",
        (F.col("start_sample") + F.when((F.col("_disc") == 0) & (F.col("_tax") == 0), F.lit(0)).otherwise(F.col("_qty") * 960)).cast("long").alias("end_sample"),
        F.greatest(F.lit(0).cast("long"), F.col("start_sample") - F.col("l_linenumber") * 4800).cast("long").alias("recording_started_sample"),
        (F.col("start_sample") + F.col("_tax") * 4800).cast("long").alias("head_silence_passed_sample"),
        F.lit(24000).cast("long").alias("required_head_silence_samples"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.col("start_sample") + F.col("_disc") * 6000).cast("long").alias("content_started_sample"),
        (F.col("_tax") == 8).alias("forced_without_tail_silence"),
        F.when(F.col("l_linenumber") != 1, F.col("_qty") * 1200).cast("long").alias("tail_silence_samples"),
        F.lit(24000).cast("long").alias("required_tail_silence_samples"),
        (F.col("l_quantity") / 50).alias("peak"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "needs_rerecord")
        .when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "interrupted").otherwise("accepted").alias("status"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """One script item per order: session = customer, order = order key."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("item_id"),
        F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "accepted")
        .when(F.col("o_orderpriority") == "5-LOW", "skipped").otherwise("review").alias("status"),
        F.concat(F.lit("a"), (F.col("o_orderkey") % 7 + 1).cast("string")).alias("selected_attempt_id"),
        F.col("o_orderpriority").alias("label"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """One script item per turn: session = conversation, order = turn."""
    c = table(spark, sf, "conversations")
    n = F.length("text") % 5
    return c.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text",
        F.when(n == 0, "pending").when(n == 1, "review").when(n == 4, "skipped").otherwise("accepted").alias("status"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One snapshot candidate per order: directory = customer."""
    o = table(spark, sf, "orders")
    own = F.concat(F.lit("s"), F.col("o_custkey").cast("string"))
    price = F.col("o_totalprice")
    return o.select(
        F.col("o_custkey").alias("session_dir"),
        F.when(F.col("o_orderkey") % 97 == 0, F.concat(F.lit("x"), own)).otherwise(own).alias("session_id"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01")).cast("long").alias("journal_seq"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 40).when(F.col("o_orderpriority") == "2-HIGH", 30)
        .when(F.col("o_orderpriority") == "3-MEDIUM", 20).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", 10).otherwise(9).alias("priority"),
        F.col("o_orderkey").alias("ordinal"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01")).cast("long") * 86400 + F.col("o_orderkey") % 86400).alias("modified_at"),
        F.when(F.col("o_orderstatus") == "P", "recording").when(F.col("o_orderstatus") == "F", "stopped")
        .when(price > 400000, "faulted").otherwise("stopping").alias("status"),
        F.when(price > 490000, 1).otherwise(0).cast("long").alias("overflow_samples"),
        (F.floor(price).cast("long") * 100).alias("committed_samples"),
        (F.floor(price).cast("long") * 100 + F.col("o_orderkey") % 3).alias("captured_samples"),
    )


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """Fault marker files: one row per marker object."""
    c = table(spark, sf, "customer")
    return c.where((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_acctbal") < 1500)).select(
        F.col("c_custkey").alias("session_dir"),
        F.when(F.col("c_custkey") % 2 == 0, "audio-fault.json").otherwise("audio-fault.tmp").alias("name"),
        (F.lit(900_000_000) + F.col("c_custkey") * 1000).cast("long").alias("modified_at"))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """One history row per customer."""
    c = table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("session_id"),
        F.when(F.col("c_custkey") % 7 == 0, "recording").when(F.col("c_custkey") % 7 == 1, "stopping")
        .when(F.col("c_custkey") % 7 == 2, "faulted").otherwise("stopped").alias("status"),
        F.when(F.col("c_acctbal") > 9000, 3).otherwise(0).cast("long").alias("overflow_samples"),
        (F.col("c_custkey") % 11 == 0).alias("is_active"),
        (F.col("c_custkey") % 13 == 0).alias("history_issue"),
        (F.col("c_custkey") % 17 == 0).alias("readonly"),
        (F.col("c_nationkey") % 3).cast("long").alias("pending_items"),
        (F.col("c_nationkey") % 2).cast("long").alias("review_items"),
        (F.col("c_acctbal") < 0).alias("fault_marker"),
        F.when(F.col("c_acctbal") < 500, "critical").when(F.col("c_acctbal") < 2000, "warning").otherwise("healthy").alias("storage_status"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", "connecting").when(F.col("c_mktsegment") == "MACHINERY", "offline").otherwise("online").alias("engine_status"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """One 64-sample block per vector: session = label, order = vector id."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.col("label").cast("long").alias("session_id"), F.col("vec_id").alias("seq"),
        (F.col("vec_id") * 64).alias("block_start"), (F.col("vec_id") * 64 + 64).alias("block_end"),
        F.col("embedding").alias("samples"))


def devices(spark: SparkSession, sf: str) -> DataFrame:
    """One input device per part: host = part size."""
    p = table(spark, sf, "part")
    key = F.col("p_partkey")
    return p.select(
        F.col("p_size").cast("long").alias("host_id"), key.alias("position"),
        F.concat(F.lit("dev-"), F.col("p_brand"), F.lit("-"), (key % 5).cast("string")).alias("device_id"),
        F.when(F.col("p_name").startswith("red"), F.concat(F.lit("Bluetooth "), F.col("p_name")))
        .when(F.col("p_name").startswith("old"), F.concat(F.lit("Realtek "), F.col("p_name")))
        .when(F.col("p_name").startswith("hot"), F.lit("  ")).otherwise(F.col("p_name")).alias("name"),
        (key % 9 == 0).alias("is_default"),
        F.when(F.col("p_type") == "ECONOMY", "i16").when(F.col("p_type") == "MEDIUM", "I24").when(F.col("p_type") == "PROMO", "f32")
        .when(F.col("p_type") == "LARGE", "i32").when(F.col("p_type") == "SMALL", "u8").otherwise("f64").alias("sample_format"),
        F.when(key % 3 == 0, 8000).otherwise(44100).cast("long").alias("min_sample_rate"),
        F.when(key % 4 == 0, 44100).when(key % 4 == 1, 48000).otherwise(192000).cast("long").alias("max_sample_rate"),
        (key % 4 + 1).alias("channels"),
        F.when(key % 2 == 0, "exclusive").when(key % 7 == 1, F.lit(None)).otherwise("shared").alias("share_mode"),
    )


SQL = {
    "ev": f"""
      SELECT user_id AS session_id, event_id AS seq, (epoch_us(ts) - {EPOCH_US}) // 1000 AS at_ms,
             event_type AS phase, value, props, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
      FROM events""",
    "ev2": """
      SELECT *, greatest(0, at_ms * 48 - CASE WHEN k = 0 THEN 4000000000 ELSE 0 END)::BIGINT AS captured_samples FROM ev""",
    "telemetry": """
      SELECT *, at_ms / 1000.0::DOUBLE AS elapsed_seconds,
             greatest(0, captured_samples - floor(value * 2400)::BIGINT)::BIGINT AS committed_samples,
             (CASE WHEN phase = 'error' AND k >= 95 THEN k ELSE 0 END)::BIGINT AS overflow_samples,
             (phase = 'error' AND k < 60) AS faulted,
             CASE WHEN phase = 'error' THEN CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN 'device_unavailable' ELSE 'input_stream_error' END END AS fault_kind,
             (phase = 'signup' AND k < 3) AS fault_marker_exists,
             CASE WHEN value > 200 THEN 'critical' WHEN value > 120 THEN 'warning' ELSE 'healthy' END AS storage_status,
             least(1.0::DOUBLE, value / 100) AS peak, least(1.0::DOUBLE, value / 100) / 4 AS rms,
             (at_ms // 172800000 * 1000000)::BIGINT AS segment_total_bytes, value > 40 AS is_speech
      FROM ev2""",
    "li": """
      SELECT *, ((l_partkey % 2000) * 480 + l_linenumber)::BIGINT AS start_sample, round(l_tax * 100)::BIGINT AS x_tax,
             round(l_discount * 100)::BIGINT AS x_disc, l_quantity::BIGINT AS x_qty
      FROM lineitem""",
    "takes": """
      SELECT l_suppkey AS session_id, l_orderkey AS item_id,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS pos,
             'a' || l_linenumber AS attempt_id, start_sample,
             start_sample + CASE WHEN x_disc = 0 AND x_tax = 0 THEN 0 ELSE x_qty * 960 END AS end_sample,
             greatest(0, start_sample - l_linenumber * 4800)::BIGINT AS recording_started_sample,
             start_sample + x_tax * 4800 AS head_silence_passed_sample,
             24000::BIGINT AS required_head_silence_samples,
             CASE WHEN l_linenumber = 7 THEN 0 ELSE start_sample + x_disc * 6000 END AS content_started_sample,
             x_tax = 8 AS forced_without_tail_silence,
             CASE WHEN l_linenumber <> 1 THEN x_qty * 1200 END AS tail_silence_samples,
             24000::BIGINT AS required_tail_silence_samples,
             l_quantity / 50 AS peak,
             CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'needs_rerecord'
                  WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'interrupted' ELSE 'accepted' END AS status
      FROM li""",
    "items": """
      SELECT o_custkey AS session_id, o_orderkey AS item_id,
             CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'F' THEN 'accepted'
                  WHEN o_orderpriority = '5-LOW' THEN 'skipped' ELSE 'review' END AS status,
             'a' || (o_orderkey % 7 + 1) AS selected_attempt_id, o_orderpriority AS label
      FROM orders""",
    "turns": """
      SELECT conv_id AS session_id, turn AS pos, role, text,
             CASE length(text) % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'review' WHEN 4 THEN 'skipped' ELSE 'accepted' END AS status
      FROM conversations""",
    "candidates": """
      SELECT o_custkey AS session_dir,
             CASE WHEN o_orderkey % 97 = 0 THEN 'xs' || o_custkey ELSE 's' || o_custkey END AS session_id,
             date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS journal_seq,
             CASE left(o_orderpriority, 1) WHEN '1' THEN 40 WHEN '2' THEN 30 WHEN '3' THEN 20 WHEN '4' THEN 10 ELSE 9 END AS priority,
             o_orderkey AS ordinal,
             date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 + o_orderkey % 86400 AS modified_at,
             CASE WHEN o_orderstatus = 'P' THEN 'recording' WHEN o_orderstatus = 'F' THEN 'stopped'
                  WHEN o_totalprice > 400000 THEN 'faulted' ELSE 'stopping' END AS status,
             (CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END)::BIGINT AS overflow_samples,
             floor(o_totalprice)::BIGINT * 100 AS committed_samples,
             floor(o_totalprice)::BIGINT * 100 + o_orderkey % 3 AS captured_samples
      FROM orders""",
    "markers": """
      SELECT c_custkey AS session_dir, CASE WHEN c_custkey % 2 = 0 THEN 'audio-fault.json' ELSE 'audio-fault.tmp' END AS name,
             900000000 + c_custkey * 1000 AS modified_at
      FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal < 1500""",
    "history": """
      SELECT c_custkey AS session_id,
             CASE c_custkey % 7 WHEN 0 THEN 'recording' WHEN 1 THEN 'stopping' WHEN 2 THEN 'faulted' ELSE 'stopped' END AS status,
             (CASE WHEN c_acctbal > 9000 THEN 3 ELSE 0 END)::BIGINT AS overflow_samples,
             c_custkey % 11 = 0 AS is_active, c_custkey % 13 = 0 AS history_issue, c_custkey % 17 = 0 AS readonly,
             (c_nationkey % 3)::BIGINT AS pending_items, (c_nationkey % 2)::BIGINT AS review_items, c_acctbal < 0 AS fault_marker,
             CASE WHEN c_acctbal < 500 THEN 'critical' WHEN c_acctbal < 2000 THEN 'warning' ELSE 'healthy' END AS storage_status,
             CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'connecting' WHEN 'MACHINERY' THEN 'offline' ELSE 'online' END AS engine_status
      FROM customer""",
    "blocks": """
      SELECT label::BIGINT AS session_id, vec_id AS seq, vec_id * 64 AS block_start, vec_id * 64 + 64 AS block_end, embedding AS samples
      FROM embeddings""",
    "devices": """
      SELECT p_size::BIGINT AS host_id, p_partkey AS position, 'dev-' || p_brand || '-' || (p_partkey % 5) AS device_id,
             CASE WHEN p_name LIKE 'red%' THEN 'Bluetooth ' || p_name WHEN p_name LIKE 'old%' THEN 'Realtek ' || p_name
                  WHEN p_name LIKE 'hot%' THEN '  ' ELSE p_name END AS name,
             p_partkey % 9 = 0 AS is_default,
             CASE p_type WHEN 'ECONOMY' THEN 'i16' WHEN 'MEDIUM' THEN 'I24' WHEN 'PROMO' THEN 'f32' WHEN 'LARGE' THEN 'i32'
                         WHEN 'SMALL' THEN 'u8' ELSE 'f64' END AS sample_format,
             (CASE WHEN p_partkey % 3 = 0 THEN 8000 ELSE 44100 END)::BIGINT AS min_sample_rate,
             (CASE p_partkey % 4 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 192000 END)::BIGINT AS max_sample_rate,
             p_partkey % 4 + 1 AS channels,
             CASE WHEN p_partkey % 2 = 0 THEN 'exclusive' WHEN p_partkey % 7 = 1 THEN NULL ELSE 'shared' END AS share_mode
      FROM part""",
}

NEEDS = {"ev2": ("ev",), "telemetry": ("ev2",), "takes": ("li",)}
