"""Devices, presets and entitlements."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.functions import formats, identity
from reelspark.operators import checks, devices as op

C = F.col
CLASS = """CASE WHEN trim(name) = '' THEN 'discouraged' WHEN regexp_matches(name, '(?i)array|senary|bluetooth|headset') THEN 'rejected' WHEN regexp_matches(name, '(?i)realtek|built-?in') THEN 'discouraged' ELSE 'production' END"""


@query("p10_device_class", b.with_tables("devices", f"SELECT position, {CLASS} AS class FROM devices"))
def p10(spark, sf):
    return b.devices(spark, sf).select("position", op.device_class(C("name")).alias("class"))


@query("t2_preferred_device", b.with_tables("devices", f"""
  r AS (SELECT *, {CLASS} AS class FROM devices),
  o AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY CASE class WHEN 'production' THEN 0 WHEN 'discouraged' THEN 1 ELSE 2 END, is_default DESC, position) AS rn FROM r)
  SELECT host_id, position, device_id, name FROM o WHERE rn = 1"""))
def t2(spark, sf):
    return op.preferred_device(b.devices(spark, sf))


SCORE = "CASE lower(sample_format) WHEN 'f32' THEN 9 WHEN 'i24' THEN 8 WHEN 'i16' THEN 7 WHEN 'i32' THEN 6 ELSE 0 END"


@query("t3_config_rank", b.with_tables("devices", f"""
  o AS (SELECT host_id, position, channels, {SCORE} AS score, row_number() OVER (PARTITION BY host_id ORDER BY {SCORE} DESC, channels DESC, position) AS rn FROM devices WHERE share_mode = 'exclusive')
  SELECT host_id, position, channels, score, rn::INTEGER AS rn FROM o"""))
def t3(spark, sf):
    f = F.lower("sample_format")
    score = F.when(f == "f32", 9).when(f == "i24", 8).when(f == "i16", 7).when(f == "i32", 6).otherwise(0)
    return op.rank_configurations(b.devices(spark, sf).where("share_mode = 'exclusive'"), score, True).select("host_id", "position", "channels", "score", "rn")


@query("t4_preferred_format", b.with_tables("devices", """
  r AS (SELECT host_id, CASE lower(trim(sample_format)) WHEN 'i24' THEN 0 WHEN 'f32' THEN 1 WHEN 'i32' THEN 2 WHEN 'i16' THEN 3 END AS r FROM devices)
  SELECT host_id, CASE min(r) WHEN 0 THEN 'i24' WHEN 1 THEN 'f32' WHEN 2 THEN 'i32' WHEN 3 THEN 'i16' END AS preferred FROM r GROUP BY 1"""))
def t4(spark, sf):
    return op.preferred_format(b.devices(spark, sf))


@query("p11_config_match", b.with_tables("devices", """
  SELECT position FROM devices WHERE (share_mode IS NULL OR share_mode = 'shared') AND min_sample_rate <= 48000 AND max_sample_rate >= 48000 AND channels >= 2"""))
def p11(spark, sf):
    return b.devices(spark, sf).where(op.config_match(F.lit(48000), F.lit(2), F.lit("shared"))).select("position")


def presets(spark, sf):
    p = b.table(spark, sf, "part")
    k = C("p_partkey")
    return p.select(
        (k % 20).alias("store"), F.concat(F.lit("id"), (k % 777).cast("string")).alias("id"), F.when(k % 31 == 0, F.repeat(F.lit("n"), F.lit(41))).otherwise(C("p_name")).alias("name"),
        F.when(k % 37 == 0, " ").otherwise("d").alias("device_id"), C("p_brand").alias("device_name"), F.when(k % 23 == 0, 4000).otherwise(48000).alias("sample_rate"),
        F.when(k % 19 == 0, 20).otherwise(24).alias("bit_depth"), F.when(k % 5 == 0, "").when(k % 29 == 0, "u8").otherwise("i24").alias("input_sample_format"),
        (k % 17).alias("input_channel"), (C("p_size") * 100 + 100).alias("silence_duration_ms"), F.lit(-45.0).alias("silence_threshold_dbfs"),
        F.when(k % 3 == 0, "exclusive").when(k % 41 == 1, "both").alias("capture_share_mode"), k.alias("position"))


@query("p12_preset_valid", """
  SELECT p_partkey AS position, p_partkey % 31 <> 0 AND p_partkey % 37 <> 0 AND p_partkey % 23 <> 0 AND p_partkey % 19 <> 0 AND (p_partkey % 5 = 0 OR p_partkey % 29 <> 0) AND p_partkey % 17 > 0
     AND p_size * 100 + 100 BETWEEN 200 AND 5000 AND (p_partkey % 3 = 0 OR p_partkey % 41 <> 1) AS valid FROM part""")
def p12(spark, sf):
    return presets(spark, sf).select("position", op.preset_valid().alias("valid"))


@query("u5_preset_uniqueness", """
  WITH x AS (SELECT p_partkey % 20 AS store, CASE WHEN p_partkey % 31 = 0 THEN repeat('n', 41) ELSE p_name END AS name, 'id' || (p_partkey % 777) AS id FROM part)
  SELECT store, 'name' AS field, lower(name) AS key, count(*) AS n FROM x GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT store, 'id', id, count(*) FROM x GROUP BY ALL HAVING count(*) > 1""")
def u5(spark, sf):
    return op.preset_clashes(presets(spark, sf))


def probed(spark, sf):
    d = b.devices(spark, sf)
    k = C("position")
    conf = F.struct("min_sample_rate", "max_sample_rate", "channels", "sample_format", "share_mode")
    return d.select("*", F.array(conf).alias("configurations"), F.when(k % 6 == 0, F.array(F.lit(44100), F.lit(96000))).when(k % 6 == 1, F.array(F.lit(48000))).otherwise(F.array().cast("array<int>")).alias("exclusive_rates"),
                    (k % 5 == 0).alias("exclusive_available"), F.when(k % 13 == 0, " busy ").when(k % 13 == 1, " ").alias("probe_error"))


PROBE = b.with_tables("devices", """
  x AS (SELECT position, trim(name) AS name, position % 13 = 0 AS err, position % 5 = 0 OR position % 6 <= 1 AS avail,
               position % 6 = 1 OR coalesce(share_mode = 'exclusive' AND 48000 BETWEEN min_sample_rate AND max_sample_rate, false) AS has48, CASE position % 6 WHEN 0 THEN '44100,96000' WHEN 1 THEN '48000' ELSE '' END AS rates FROM devices WHERE trim(name) <> ''),
  y AS (SELECT *, CASE WHEN err THEN 'exclusive_probe_error' WHEN avail AND NOT has48 THEN 'exclusive_missing_48k' WHEN NOT avail THEN 'exclusive_empty' END AS kind FROM x)""")


@query("p21_exclusive_probe_issue", PROBE + " SELECT position, kind FROM y WHERE kind IS NOT NULL")
def p21(spark, sf):
    return op.probe_issues(probed(spark, sf)).select("position", "kind")


@query("f27_probe_issue_key", PROBE + " SELECT position, kind || '|' || name || '|' || rates || '|' || CASE WHEN err THEN 'busy' ELSE '' END AS issue_key FROM y WHERE kind IS NOT NULL")
def f27(spark, sf):
    return op.probe_issues(probed(spark, sf)).select("position", "issue_key")


@query("s12_inventory_read", b.with_tables("devices", """
  SELECT host_id, position, device_id AS id, name, is_default, min_sample_rate, max_sample_rate, channels, sample_format, share_mode FROM devices WHERE position % 8 <> 0
  UNION ALL SELECT host_id, position, device_id, name, is_default, NULL, NULL, NULL, NULL, NULL FROM devices WHERE position % 8 = 0"""))
def s12(spark, sf):
    d = b.devices(spark, sf)
    conf = F.struct("min_sample_rate", "max_sample_rate", "channels", "sample_format", "share_mode")
    doc = F.to_json(F.struct(C("device_id").alias("id"), "name", "is_default", F.when(C("position") % 8 != 0, F.array(conf)).alias("configurations")))
    return op.read_inventory(d.select("host_id", "position", doc.alias("text")))


@query("j7_missing_configurations", b.with_tables("devices", """
  c AS (SELECT r AS rate, ch AS channel FROM (VALUES (44100), (48000), (96000)) a(r), (VALUES (2), (4), (6)) b(ch)),
  h AS (SELECT DISTINCT host_id FROM devices)
  SELECT host_id, rate::BIGINT AS rate, channel::BIGINT AS channel FROM h, c WHERE NOT EXISTS (SELECT 1 FROM devices d WHERE d.host_id = h.host_id AND min_sample_rate <= rate AND max_sample_rate >= rate AND channels >= channel)"""))
def j7(spark, sf):
    d = b.devices(spark, sf)
    return op.missing_cells(d, d.select("host_id").distinct(), (2, 4, 6))


@query("j9_required_matrix", b.with_tables("devices", """
  SELECT host_id, ch::BIGINT AS channel, r::BIGINT AS sample_rate, d::BIGINT AS bit_depth FROM (SELECT DISTINCT host_id FROM devices), (VALUES (1), (2)) b(ch), (VALUES (44100), (48000), (96000)) a(r), (VALUES (16), (24), (32)) e(d)"""))
def j9(spark, sf):
    return op.required_matrix(b.devices(spark, sf).select("host_id").distinct(), (1, 2))


@query("c1_inventory_checks", b.with_tables("devices", """
  f AS (SELECT host_id, count(*) AS n, count(DISTINCT device_id) AS di, count_if(position % 11 <> 0) AS conf FROM devices WHERE host_id % 7 <> 0 GROUP BY 1),
  h AS (SELECT DISTINCT d.host_id, coalesce(n, 0) AS n, coalesce(di, 0) AS di, coalesce(conf, 0) AS conf FROM devices d LEFT JOIN f USING (host_id))
  SELECT host_id, 'devices-present' AS check_id, CASE WHEN n > 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM h UNION ALL SELECT host_id, 'stable-device-ids', 'PASS' FROM h
  UNION ALL SELECT host_id, 'unique-device-ids', CASE WHEN di = n THEN 'PASS' ELSE 'FAIL' END FROM h UNION ALL SELECT host_id, 'driver-configurations', CASE WHEN conf = n THEN 'PASS' ELSE 'FAIL' END FROM h"""))
def c1(spark, sf):
    d = b.devices(spark, sf).withColumn("n_configurations", F.when(C("position") % 11 == 0, 0).otherwise(1))
    return checks.inventory_checks(d.where("host_id % 7 <> 0"), d.select("host_id").distinct())


@query("j10_fingerprint_overlap", """
  WITH x AS (SELECT c_custkey, [md5(c_name), md5(c_mktsegment), md5((c_nationkey)::VARCHAR)][1:(c_custkey % 4)] AS stored,
     [md5(c_name || CASE WHEN c_custkey % 5 = 0 THEN '!' ELSE '' END), md5(c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN '!' ELSE '' END), md5(c_nationkey::VARCHAR)] AS cur FROM customer),
  y AS (SELECT c_custkey, len(stored) AS n, len(list_filter(stored, lambda s: list_contains(cur, s))) AS hits FROM x)
  SELECT c_custkey, n > 0 AND CASE WHEN n >= 3 THEN hits >= 2 ELSE hits = n END AS matches FROM y""")
def j10(spark, sf):
    c = b.table(spark, sf, "customer")
    bang = lambda n: F.when(C("c_custkey") % n == 0, "!").otherwise("")
    nat = F.md5(C("c_nationkey").cast("string"))
    stored = F.slice(F.array(F.md5("c_name"), F.md5("c_mktsegment"), nat), F.lit(1), (C("c_custkey") % 4).cast("int"))
    cur = F.array(F.md5(F.concat("c_name", bang(5))), F.md5(F.concat("c_mktsegment", bang(3))), nat)
    return c.select("c_custkey", identity.fingerprint_matches(stored, cur).alias("matches"))


@query("p24_license_status", """
  WITH x AS (SELECT c_custkey, 1700000000 + c_custkey * 100 AS now, 1700000000 + c_custkey * 100 + (c_custkey % 5) * 40000 AS seen, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 1700000000 + c_custkey * 90 + (c_custkey % 7) * 86400 END AS exp FROM customer),
  y AS (SELECT *, CASE WHEN now + 86400 < seen THEN 'clock_rollback' WHEN now >= exp THEN 'expired' WHEN c_custkey % 9 = 0 AND c_custkey % 2 = 0 THEN 'wrong_machine' END AS reason FROM x)
  SELECT c_custkey, reason, CASE WHEN reason IS NULL AND exp IS NOT NULL THEN greatest(0, CAST(ceil((exp - now) / 86400.0) AS BIGINT)) END AS days_remaining FROM y""")
def p24(spark, sf):
    c = b.table(spark, sf, "customer")
    k = C("c_custkey")
    c = c.select("c_custkey", (k * 100 + 1_700_000_000).alias("now"), (k * 100 + 1_700_000_000 + k % 5 * 40_000).alias("seen"),
                 F.when(k % 6 != 0, k * 90 + 1_700_000_000 + k % 7 * 86_400).alias("exp"), F.when(k % 9 == 0, "OTHER").otherwise("M").alias("mid"), (k % 2 == 1).alias("drift"))
    c = c.withColumn("reason", identity.license_reason(C("now"), C("seen"), C("exp"), C("mid"), F.lit("M"), C("drift")))
    return c.select("c_custkey", "reason", F.when(C("reason").isNull(), identity.days_remaining(C("now"), C("exp"))).alias("days_remaining"))
