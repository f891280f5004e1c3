"""F*: scalar functions over the derived tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.functions import formats, identity, levels, samples, storage
from reelspark.operators import timeline
from reelspark.session import chunk_width

C = F.col
RATE = 48000

MS = "CASE WHEN {n} > 0 THEN floor({n} / 48000 * 1000 + 0.5)::BIGINT ELSE 0 END"


def ms(n: str) -> str:
    return MS.format(n=n)


TAKE_KEY = "session_id, item_id, attempt_id, start_sample, end_sample"
KEYS = ["session_id", "item_id", "attempt_id", "start_sample", "end_sample"]


@query("f1_samples_to_ms", b.with_tables("takes", f"""
  SELECT {TAKE_KEY}, {ms("(end_sample - start_sample)")} AS ms FROM takes"""))
def f1(spark, sf):
    return b.takes(spark, sf).select(*KEYS, samples.samples_to_ms(C("end_sample") - C("start_sample"), F.lit(RATE)).alias("ms"))


@query("f2_format_durations", b.with_tables("telemetry", """
  x AS (SELECT session_id, seq, captured_samples, captured_samples // 48000 AS s, committed_samples - 3000 AS w FROM telemetry)
  SELECT session_id, seq, greatest(0, floor(w / 48.0 + 0.5)::BIGINT) || ' ms' AS ms_text,
         printf('%.1f s', greatest(0, w) / 1000) AS wait_text,
         lpad((s // 3600)::VARCHAR, greatest(2, length((s // 3600)::VARCHAR))::INTEGER, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock
  FROM x"""))
def f2(spark, sf):
    t = b.telemetry(spark, sf)
    w = C("committed_samples") - 3000
    return t.select("session_id", "seq", samples.format_ms(w / F.lit(48.0)).alias("ms_text"),
                    samples.format_wait_seconds(w).alias("wait_text"),
                    samples.format_duration(C("captured_samples"), F.lit(RATE)).alias("clock"))


@query("f3_dbfs", b.with_tables("telemetry", """
  SELECT session_id, seq,
         round(CASE WHEN peak > 0 THEN greatest(-96.0::DOUBLE, 20 * log10(peak)) ELSE -96.0::DOUBLE END, 6) AS peak_dbfs,
         round(CASE WHEN rms * rms > 1e-12 THEN greatest(-96.0::DOUBLE, 10 * log10(rms * rms)) ELSE -96.0::DOUBLE END, 6) AS power_dbfs
  FROM telemetry"""))
def f3(spark, sf):
    return b.telemetry(spark, sf).select(
        "session_id", "seq", F.round(levels.linear_dbfs(C("peak")), 6).alias("peak_dbfs"),
        F.round(levels.power_dbfs(C("rms") * C("rms")), 6).alias("power_dbfs"))


@query("f4_noise_percent", b.with_tables("telemetry", """
  SELECT session_id, seq, round(least(100.0::DOUBLE, greatest(0.0::DOUBLE, (value - 90 + 72) / 66 * 100)), 6) AS percent FROM telemetry"""))
def f4(spark, sf):
    return b.telemetry(spark, sf).select("session_id", "seq", F.round(levels.noise_percent(C("value") - 90), 6).alias("percent"))


PAD_START = """CASE WHEN head_silence_passed_sample > 0 AND head_silence_passed_sample >= 24000
  THEN greatest(recording_started_sample, head_silence_passed_sample - 24000) ELSE recording_started_sample END"""


@query("f5_head_pad_start", b.with_tables("takes", f"SELECT {TAKE_KEY}, {PAD_START} AS pad_start FROM takes"))
def f5(spark, sf):
    return b.takes(spark, sf).select(*KEYS, samples.head_pad_start(
        C("recording_started_sample"), C("head_silence_passed_sample"), C("required_head_silence_samples")).alias("pad_start"))


PAD_START_OR = """CASE WHEN head_silence_passed_sample > 0 AND head_silence_passed_sample >= 24000
  THEN greatest(coalesce(nullif(recording_started_sample, 0), start_sample), head_silence_passed_sample - 24000)
  ELSE coalesce(nullif(recording_started_sample, 0), start_sample) END"""


@query("f6_head_start", b.with_tables("takes", f"""
  SELECT {TAKE_KEY}, start_sample AS vad_start, {PAD_START_OR} AS energy_start FROM takes"""))
def f6(spark, sf):
    t = b.takes(spark, sf)
    args = (C("start_sample"), C("recording_started_sample"), C("head_silence_passed_sample"), C("required_head_silence_samples"))
    return t.select(*KEYS, samples.head_start(F.lit("vad"), *args).alias("vad_start"),
                    samples.head_start(F.lit("energy"), *args).alias("energy_start"))


@query("f7_head_silence_ms", b.with_tables("takes", f"""
  SELECT {TAKE_KEY}, CASE WHEN content_started_sample > 0 THEN {ms("greatest(0, content_started_sample - start_sample)")} END AS head_ms FROM takes"""))
def f7(spark, sf):
    return b.takes(spark, sf).select(*KEYS, samples.head_silence_ms(C("start_sample"), C("content_started_sample"), F.lit(RATE)).alias("head_ms"))


@query("f8_pad_status", b.with_tables("takes", f"""
  x AS (SELECT *, CASE WHEN tail_silence_samples IS NOT NULL THEN {ms("tail_silence_samples")} END AS tail_ms FROM takes)
  SELECT {TAKE_KEY}, CASE WHEN tail_ms IS NULL THEN 'unknown' WHEN tail_ms < 500 THEN 'short' ELSE 'met' END AS tail_status FROM x"""))
def f8(spark, sf):
    t = b.takes(spark, sf)
    tail = F.when(C("tail_silence_samples").isNotNull(), samples.samples_to_ms(C("tail_silence_samples"), F.lit(RATE)))
    return t.select(*KEYS, samples.pad_status(tail, F.lit(500)).alias("tail_status"))


@query("f10_peak_note", b.with_tables("takes", f"""
  SELECT {TAKE_KEY}, CASE WHEN peak > 0.92 THEN 'clip' WHEN peak < 0.04 THEN 'quiet' END AS note FROM takes"""))
def f10(spark, sf):
    return b.takes(spark, sf).select(*KEYS, levels.peak_note(C("peak")).alias("note"))


@query("f11_storage_report", """
  WITH x AS (SELECT o_orderkey, (floor(o_totalprice)::BIGINT * 30000) AS available,
                    (CASE o_orderkey % 3 WHEN 0 THEN 44100 WHEN 1 THEN 48000 ELSE 96000 END) * (o_orderkey % 2 + 1)
                    * (CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 END) AS bps FROM orders),
  y AS (SELECT *, greatest(1073741824, bps * 1800) AS critical, greatest(5368709120, bps * 14400) AS warning, greatest(2147483648, bps * 7200) AS startup FROM x)
  SELECT o_orderkey, bps::BIGINT AS bytes_per_second,
         CASE WHEN bps IS NULL THEN NULL WHEN available <= critical THEN 'critical' WHEN available <= warning THEN 'warning' ELSE 'healthy' END AS status,
         CASE WHEN bps IS NOT NULL THEN available >= startup END AS can_start, CASE WHEN bps IS NOT NULL THEN startup::BIGINT END AS startup_required_bytes, (available // bps)::BIGINT AS remaining_recording_seconds,
         CASE WHEN bps IS NOT NULL THEN (greatest(0, available - critical) // bps)::BIGINT END AS safe_recording_seconds
  FROM y""")
def f11(spark, sf):
    o = b.table(spark, sf, "orders")
    key = C("o_orderkey")
    rate = F.when(key % 3 == 0, 44100).when(key % 3 == 1, 48000).otherwise(96000)
    depth = F.when(key % 5 == 0, 16).when(key % 5 == 1, 24).when(key % 5 == 2, 32).otherwise(20)
    o = o.select("o_orderkey", (F.floor("o_totalprice").cast("long") * 30000).alias("available"),
                 storage.bytes_per_second(rate.cast("long"), key % 2 + 1, depth).alias("bps"))
    r = F.when(C("bps").isNotNull(), storage.storage_report(C("available"), C("bps")))  # a depth without a rate has no report
    return o.select("o_orderkey", C("bps").alias("bytes_per_second"), r.alias("r")).select(
        "o_orderkey", "bytes_per_second", "r.status", "r.can_start", "r.startup_required_bytes",
        "r.remaining_recording_seconds", "r.safe_recording_seconds")


@query("f12_wav_plan", """
  WITH x AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT * 10000 AS frames, CASE o_orderkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 24 ELSE 32 END AS depth FROM orders),
  y AS (SELECT *, frames * depth // 8 AS data, CASE WHEN depth = 32 THEN 56 ELSE 44 END AS header FROM x)
  SELECT o_orderkey, CASE WHEN header - 8 + data + data % 2 > 4294967295 THEN 'rf64' ELSE 'riff' END AS container, data::BIGINT AS data_bytes,
         (header + data + data % 2 + CASE WHEN header - 8 + data + data % 2 > 4294967295 THEN 36 ELSE 0 END)::BIGINT AS file_bytes FROM y""")
def f12(spark, sf):
    o = b.table(spark, sf, "orders")
    depth = F.when(C("o_orderkey") % 3 == 0, 16).when(C("o_orderkey") % 3 == 1, 24).otherwise(32)
    return o.select("o_orderkey", storage.wav_plan(F.floor("o_totalprice").cast("long") * 10000, F.lit(1), depth).alias("p")).select("o_orderkey", "p.*")


@query("f13_required_data_bytes", """
  SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN 48000 * ((o_orderkey % 4 + 2) * 8 / 8) * (o_orderkey % 9)::DOUBLE * 3600 END AS required_bytes FROM orders""")
def f13(spark, sf):
    o = b.table(spark, sf, "orders")
    return o.select("o_orderkey", storage.required_data_bytes(
        F.lit(48000), (C("o_orderkey") % 4 + 2) * 8, (C("o_orderkey") % 9).cast("double")).alias("required_bytes"))


@query("f14_precision_bits", b.with_tables("devices", """
  x AS (SELECT *, lower(trim(sample_format)) AS f FROM devices)
  SELECT position, CASE f WHEN 'i16' THEN 16 WHEN 'i24' THEN 24 WHEN 'f32' THEN 24 WHEN 'i32' THEN 32 WHEN 'u8' THEN 8 WHEN 'f64' THEN 53 END AS bits,
         CASE f WHEN 'i16' THEN 16 WHEN 'i24' THEN 24 ELSE 32 END AS depth,
         CASE f WHEN 'i16' THEN 16 ELSE 24 END AS minimum FROM x"""))
def f14(spark, sf):
    d = b.devices(spark, sf)
    fmt = C("sample_format")
    return d.select("position", formats.precision_bits(fmt).alias("bits"), formats.delivery_depth(fmt).alias("depth"),
                    formats.minimum_bits(formats.delivery_depth(fmt)).alias("minimum"))


@query("f15_take_bounds", b.with_tables("takes", f"""
  x AS (SELECT *, CASE WHEN content_started_sample <= 0 THEN recording_started_sample ELSE greatest(recording_started_sample, content_started_sample - 9600) END AS vad_start,
               greatest(0, end_sample - 20000) AS last_speech FROM takes),
  y AS (SELECT *, CASE WHEN last_speech <= 0 THEN end_sample ELSE greatest(vad_start + 1, least(end_sample, last_speech + 9600)) END AS e FROM x)
  SELECT {TAKE_KEY}, vad_start, CASE WHEN head_silence_passed_sample > 0 THEN head_silence_passed_sample ELSE recording_started_sample END AS gate_start,
         CASE WHEN e < end_sample THEN e END AS vad_end FROM y"""))
def f15(spark, sf):
    t = b.takes(spark, sf)
    pad = F.lit(9600)
    args = (F.lit(True), C("recording_started_sample"), C("head_silence_passed_sample"), C("content_started_sample"), pad)
    t = t.select(*KEYS, samples.take_start(F.lit("vad"), *args).alias("vad_start"), samples.take_start(F.lit("energy"), *args).alias("gate_start"))
    last = F.greatest(F.lit(0).cast("long"), C("end_sample") - 20000)
    return t.select("*", samples.take_end(F.lit("vad"), C("end_sample"), last, pad, C("vad_start")).alias("vad_end"))


@query("f18_machine_code", """
  WITH x AS (SELECT c_custkey, translate(upper(md5(c_name)), 'OIL', '011') AS c FROM customer),
  y AS (SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 5 = 0 THEN left(c, 11) ELSE left(c, 3) || 'U' || substr(c, 4, 9) END, '[^0-9A-HJKMNP-TV-Z]', '', 'g') AS c FROM x)
  SELECT y.c_custkey, CASE WHEN length(y.c) = 12 THEN substr(y.c, 1, 4) || '-' || substr(y.c, 5, 4) || '-' || substr(y.c, 9, 4) END AS machine_code,
         sha256(array_to_string(list_sort([md5(c_name), md5(c_mktsegment)]), ',')) AS digest
  FROM y JOIN customer USING (c_custkey)""")
def f18(spark, sf):
    c = b.table(spark, sf, "customer")
    raw = F.md5(C("c_name"))
    typed = F.when(C("c_custkey") % 5 == 0, F.substring(raw, 1, 11)).otherwise(
        F.concat(F.substring(raw, 1, 3), F.lit("u"), F.substring(raw, 4, 9)))
    return c.select("c_custkey", identity.normal_machine_code(typed).alias("machine_code"),
                    identity.component_digest(F.array(F.md5("c_name"), F.md5("c_mktsegment"))).alias("digest"))


@query("f19_expiry", """
  WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 6 = 1 THEN strftime(o_orderdate, '%Y-%m') || '-32' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderdate FROM orders)
  SELECT o_orderkey, CASE WHEN o_orderkey % 6 > 1 THEN (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) + 1) * 86400 END AS expires,
         CASE WHEN o_orderkey % 6 > 1 THEN day END AS last_day FROM x""")
def f19(spark, sf):
    o = b.table(spark, sf, "orders")
    d = C("o_orderdate").cast("date")
    day = (F.when(C("o_orderkey") % 6 == 0, F.date_format(d, "yyyy/MM/dd"))
           .when(C("o_orderkey") % 6 == 1, F.concat(F.date_format(d, "yyyy-MM"), F.lit("-32"))).otherwise(F.date_format(d, "yyyy-MM-dd")))
    o = o.select("o_orderkey", identity.expiry_seconds(day).alias("expires"))
    return o.select("*", identity.expiry_day(C("expires")).alias("last_day"))


@query("f22_channel_mean", b.with_tables("blocks", """
  SELECT session_id, seq, round(list_sum(list_transform(samples, lambda x: (x::DOUBLE + x::DOUBLE / 2 + 0) / 3)), 6) AS mono_sum,
         round(((samples[1]::DOUBLE + (samples[1]::DOUBLE / 2)) / 3), 6) AS first_sample
  FROM blocks"""))
def f22(spark, sf):
    bl = b.blocks(spark, sf)
    chan = C("samples").cast("array<double>")
    half = F.transform(chan, lambda x: x / 2)
    mono = levels.channel_mean(F.array(chan, half, F.array().cast("array<double>")))
    return bl.select("session_id", "seq", mono.alias("m")).select(
        "session_id", "seq", F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("mono_sum"),
        F.round(F.element_at("m", 1), 6).alias("first_sample"))


@query("f23_resample", b.with_tables("blocks", """
  o AS (SELECT session_id, seq, samples, unnest(range(0, 21)) AS i FROM blocks),
  p AS (SELECT *, i * 3.0::DOUBLE AS src FROM o),
  v AS (SELECT session_id, seq, i, samples[least(63, floor(src)::BIGINT) + 1]::DOUBLE * (1.0 - (src - least(63, floor(src)::BIGINT)))
               + samples[least(63, least(63, floor(src)::BIGINT) + 1) + 1]::DOUBLE * (src - least(63, floor(src)::BIGINT)) AS y FROM p)
  SELECT session_id, seq, count(*) AS n, round(sum(y), 6) AS total FROM v GROUP BY ALL"""))
def f23(spark, sf):
    bl = b.blocks(spark, sf)
    return bl.select("session_id", "seq", levels.resample(C("samples"), F.lit(48000), F.lit(16000)).alias("y")).select(
        "session_id", "seq", F.size("y").cast("long").alias("n"), F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("f23_resample_stream", b.with_tables("blocks", """
  bl AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) * 64 AS bs, samples FROM blocks),
  sm AS (SELECT session_id, bs + unnest(range(0, 64)) AS p, unnest(samples)::DOUBLE AS v FROM bl),
  n AS (SELECT session_id, count(*) AS n FROM sm GROUP BY 1),
  k AS (SELECT session_id, unnest(range(0, n * 16000 // 44100 + 2)) AS k FROM n),
  y AS (SELECT k.session_id, k, k * 44100 // 16000 AS i, l.v + (r.v - l.v) * ((k * 44100 % 16000) / 16000.0::DOUBLE) AS y
        FROM k JOIN sm l ON l.session_id = k.session_id AND l.p = k * 44100 // 16000 JOIN sm r ON r.session_id = k.session_id AND r.p = k * 44100 // 16000 + 1)
  SELECT session_id, i // 64 * 64 AS block_start, min(k) AS first, count(*) AS n, round(sum(y), 6) AS total FROM y GROUP BY ALL"""))
def f23_stream(spark, sf):
    """44.1 to 16 kHz over block borders."""
    out = timeline.resample_blocks(timeline.contiguous_blocks(b.blocks(spark, sf), chunk_width(spark)), 44_100, 16_000).where(F.size("resampled") > 0)
    return out.select("session_id", "block_start", "first", F.size("resampled").cast("long").alias("n"), F.round(F.aggregate("resampled", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("f24_discontinuity_ms", b.with_tables("telemetry", """
  SELECT session_id, seq, floor(committed_samples / 44100 * 1000 + 0.5)::BIGINT AS ms FROM telemetry"""))
def f24(spark, sf):
    return b.telemetry(spark, sf).select("session_id", "seq", samples.discontinuity_ms(C("committed_samples"), F.lit(44100)).alias("ms"))
