"""Segments, takes, bins and frames on the sample timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.operators import timeline as op
from reelspark.session import chunk_width

C = F.col
L = 48_000

# Every supplier is a session of about a million frames in segments of one second.
SEGMENTS = """
  tot AS (SELECT s_suppkey AS session_id, 1008000 - s_suppkey % 5 * 48000 - s_suppkey % 3 * 1000 AS total FROM supplier),
  seg AS (SELECT session_id, total, unnest(range(0, CAST(ceil(total / 48000.0) AS BIGINT))) AS segment_index FROM tot),
  segments AS (SELECT session_id, total, segment_index, segment_index * 48000 AS global_start_frame, least(48000, total - segment_index * 48000) AS frames FROM seg)"""


def segments(spark, sf):
    s = b.table(spark, sf, "supplier")
    k = C("s_suppkey")
    t = s.select(k.alias("session_id"), (F.lit(1_008_000) - k % 5 * 48_000 - k % 3 * 1000).cast("long").alias("total"))
    t = t.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(C("total") / F.lit(float(L))).cast("long") - 1)).alias("segment_index"))
    return t.select("*", (C("segment_index") * L).alias("global_start_frame"),
                    F.least(F.lit(L).cast("long"), C("total") - C("segment_index") * L).alias("frames"))


TAKE_COLS = ["session_id", "item_id", "pos", "attempt_id", "start_sample", "end_sample"]
TAKE_SQL = "session_id, item_id, pos, attempt_id, start_sample, end_sample"


@query("j1_take_x_segment", b.with_tables("takes", SEGMENTS + """,
  j AS (SELECT t.*, segment_index, greatest(start_sample, global_start_frame) AS part_start, least(end_sample, global_start_frame + frames) - greatest(start_sample, global_start_frame) AS part_frames, global_start_frame
        FROM takes t JOIN segments s ON t.session_id = s.session_id AND start_sample < global_start_frame + frames AND global_start_frame < end_sample
        WHERE end_sample > start_sample)
  SELECT session_id, item_id, attempt_id, start_sample, end_sample, segment_index, part_start, part_frames, part_start - global_start_frame AS local_start FROM j"""))
def j1(spark, sf):
    t = b.takes(spark, sf).select(*TAKE_COLS)
    return op.take_parts(t, segments(spark, sf), L).where("part_frames is not null").select(
        "session_id", "item_id", "attempt_id", "start_sample", "end_sample", "segment_index", "part_start", "part_frames", "local_start")


@query("j1_take_coverage", b.with_tables("takes", SEGMENTS + f""",
  j AS (SELECT t.session_id, t.item_id, t.pos, count(segment_index) AS parts, coalesce(sum(least(end_sample, global_start_frame + frames) - greatest(start_sample, global_start_frame)) FILTER (WHERE segment_index IS NOT NULL), 0)::BIGINT AS mapped_frames
        FROM takes t LEFT JOIN segments s ON t.session_id = s.session_id AND start_sample < global_start_frame + frames AND global_start_frame < end_sample AND end_sample > start_sample
        GROUP BY ALL)
  SELECT session_id, item_id, attempt_id, start_sample, end_sample, parts, mapped_frames,
         CASE WHEN end_sample <= start_sample THEN 'empty_range' WHEN mapped_frames <> end_sample - start_sample THEN 'not_covered' END AS error
  FROM j JOIN takes USING (session_id, item_id, pos)"""))
def j1_coverage(spark, sf):
    t = b.takes(spark, sf).select(*TAKE_COLS)
    return op.take_coverage(t, segments(spark, sf), L, ["item_id", "pos", "attempt_id"]).drop("pos")


@query("j2_sample_in_take", b.with_tables("takes", """
  p AS (SELECT event_id AS point_id, user_id % 100 AS session_id, event_id * 7919 % 1000000 AS sample FROM events),
  t AS (SELECT session_id, start_sample, CASE WHEN start_sample > 958000 THEN NULL ELSE end_sample END AS end_sample FROM takes)
  SELECT point_id, session_id, sample, EXISTS (SELECT 1 FROM t WHERE t.session_id = p.session_id AND t.start_sample <= p.sample AND (t.end_sample IS NULL OR p.sample < t.end_sample)) AS in_take FROM p"""))
def j2(spark, sf):
    e = b.table(spark, sf, "events").select(
        C("event_id").alias("point_id"), (C("user_id") % 100).alias("session_id"), (C("event_id") * 7919 % 1_000_000).alias("sample"))
    t = b.takes(spark, sf).select(
        "session_id", "start_sample", F.when(C("start_sample") <= 958_000, C("end_sample")).alias("end_sample"))
    return op.points_in_takes(e, t, chunk_width(spark))


# One-based numbers with some segments lost.
NUMBERED = SEGMENTS + """,
  numbered AS (SELECT session_id, total, segment_index + 1 AS segment_index, CASE WHEN session_id % 6 = 0 AND segment_index = 3 THEN frames - 7 ELSE frames END AS frames
               FROM segments WHERE (session_id * 7 + segment_index) % 211 <> 0)"""


def numbered(spark, sf):
    s = segments(spark, sf).where((C("session_id") * 7 + C("segment_index")) % 211 != 0)
    short = (C("session_id") % 6 == 0) & (C("segment_index") == 3)
    return s.select("session_id", "total", (C("segment_index") + 1).alias("segment_index"), F.when(short, C("frames") - 7).otherwise(C("frames")).alias("frames"))


@query("w4_numbering_gap", b.with_tables("takes", NUMBERED + """,
  r AS (SELECT session_id, segment_index, row_number() OVER (PARTITION BY session_id ORDER BY segment_index) AS rn FROM numbered)
  SELECT session_id, min(segment_index) AS first_wrong_index, count(*) AS wrong_segments FROM r WHERE rn <> segment_index GROUP BY 1"""))
def w4(spark, sf):
    return op.numbering_gaps(numbered(spark, sf), chunk_width(spark))


@query("w5_global_offset", b.with_tables("takes", NUMBERED + """,
  r AS (SELECT *, coalesce(sum(frames) OVER (PARTITION BY session_id ORDER BY segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS global_start_frame,
               lead(segment_index) OVER (PARTITION BY session_id ORDER BY segment_index) IS NULL AS is_last FROM numbered)
  SELECT session_id, segment_index, frames, global_start_frame, CASE WHEN NOT is_last AND frames <> 48000 THEN 'closed_length' WHEN is_last AND frames > 48000 THEN 'too_long' END AS layout_error FROM r"""))
def w5(spark, sf):
    return op.global_offsets(numbered(spark, sf), L, chunk_width(spark)).select("session_id", "segment_index", "frames", "global_start_frame", "layout_error")


@query("w6_provenance_contiguity", b.with_tables("takes", SEGMENTS + """,
  sp AS (SELECT session_id, segment_index AS span, CASE WHEN session_id % 4 = 0 AND segment_index = 5 THEN global_start_frame + 1 ELSE global_start_frame END AS s, global_start_frame + frames AS e
         FROM segments WHERE session_id % 9 <> 0),
  x AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY session_id ORDER BY span), 0) AS pe FROM sp),
  a AS (SELECT session_id, bool_and(s = pe AND e >= s) AS tiled, arg_max(e, span) AS cursor FROM x GROUP BY 1)
  SELECT tot.session_id, coalesce(tiled AND cursor = CASE WHEN tot.session_id % 7 = 0 THEN total + 1 ELSE total END, true) AS provenance_valid FROM tot LEFT JOIN a USING (session_id)"""))
def w6(spark, sf):
    s = segments(spark, sf)
    broken = (C("session_id") % 4 == 0) & (C("segment_index") == 5)
    spans = s.where(C("session_id") % 9 != 0).select(
        "session_id", C("segment_index").alias("span"), (C("global_start_frame") + broken.cast("long")).alias("start_sample"),
        (C("global_start_frame") + C("frames")).alias("end_sample"))
    committed = s.where("segment_index = 0").select("session_id", (C("total") + (C("session_id") % 7 == 0).cast("long")).alias("committed_samples"))
    return op.provenance_valid(spans, committed, chunk_width(spark))


@query("a13_physical_totals", b.with_tables("takes", SEGMENTS + """
  SELECT session_id, count(*) AS segments, sum(frames)::BIGINT AS physical_frames, sum(frames * 3 + 44)::BIGINT AS file_bytes FROM segments GROUP BY 1"""))
def a13(spark, sf):
    return op.physical_totals(segments(spark, sf), 3, 44)


SHIFTED = "SELECT session_id, seq, block_start + 32 AS block_start, block_end + 32 AS block_end, samples FROM blocks"


@query("a4_waveform_envelope", b.with_tables("blocks", f"""
  s AS ({SHIFTED}),
  x AS (SELECT session_id, block_start + i AS p, greatest(-1.0::FLOAT, least(1.0::FLOAT, samples[i + 1])) AS v FROM (SELECT *, unnest(range(0, 64)) AS i FROM s))
  SELECT session_id, p // 64 AS bin, count(*) AS samples, least(0, min(v))::FLOAT AS lo, greatest(0, max(v))::FLOAT AS hi FROM x GROUP BY ALL"""))
def a4(spark, sf):
    s = b.blocks(spark, sf).withColumn("block_start", C("block_start") + 32).withColumn("block_end", C("block_end") + 32)
    return op.envelope(s)


@query("a5_take_peak", b.with_tables("blocks", """
  p AS (SELECT session_id, max(list_max(list_transform(samples, lambda x: abs(x::DOUBLE)))) AS bp FROM blocks GROUP BY 1)
  SELECT session_id, greatest(least(bp, 1.0::DOUBLE), session_id / 12.0::DOUBLE) AS peak FROM p"""))
def a5(spark, sf):
    bl = b.blocks(spark, sf)
    stored = bl.select("session_id").distinct().select(
        "session_id", (C("session_id") / F.lit(12.0)).alias("stored_peak"), F.lit(float("nan")).alias("live_peak"))
    return op.take_peak(op.envelope(bl), stored)


@query("a7_bandwidth_verdict", b.with_tables("blocks", """
  c AS (SELECT session_id, seq, samples, (row_number() OVER (PARTITION BY session_id ORDER BY seq DESC) - 1) * 64 AS newer FROM blocks),
  k AS (SELECT * FROM c WHERE newer < 16384),
  x AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq, i) - 1) AS n, v
        FROM (SELECT session_id, seq, unnest(range(0, 64)) AS i, unnest(samples)::DOUBLE AS v FROM k)),
  t AS (SELECT session_id, count(*) AS n FROM x GROUP BY 1),
  f AS (SELECT session_id, unnest(range(0, (n - 2048) // 1024 + 1)) AS f FROM t WHERE n >= 2048),
  w AS (SELECT f.session_id, f.f, n - f.f * 1024 AS j, v * (0.5 - 0.5 * cos(2 * pi() * (n - f.f * 1024) / 2047.0)) AS y FROM f JOIN x ON x.session_id = f.session_id AND n >= f.f * 1024 AND n < f.f * 1024 + 2048),
  bins AS (SELECT b, b * 48000 / 2048.0 AS hz FROM (SELECT unnest(range(1, 1024)) AS b)),
  pw AS (SELECT w.session_id, w.f, b, hz, power(sum(y * cos(2 * pi() * ((b * j) % 2048) / 2048.0)), 2) + power(sum(y * sin(2 * pi() * ((b * j) % 2048) / 2048.0)), 2) AS p
         FROM w JOIN bins ON (hz >= 2000 AND hz < 6000) OR (hz >= 8000 AND hz < 16000) GROUP BY ALL),
  fr AS (SELECT session_id, f, sum(CASE WHEN hz < 6000 THEN p ELSE 0 END) AS mid, sum(CASE WHEN hz >= 8000 THEN p ELSE 0 END) AS high FROM pw GROUP BY ALL),
  av AS (SELECT session_id, avg(mid) AS mid, avg(high) AS high FROM fr GROUP BY 1),
  r AS (SELECT t.session_id, t.n AS samples, coalesce(10 * log10(mid) >= -70, false) AS conclusive, 10 * log10(high / mid) AS ratio FROM t LEFT JOIN av USING (session_id))
  SELECT session_id, samples, conclusive, CASE WHEN conclusive THEN round(ratio, 4) END AS ratio_db, NOT conclusive OR ratio > -30 AS passed FROM r"""))
def a7(spark, sf):
    v = op.bandwidth_verdict(b.blocks(spark, sf), 48_000, chunk_width(spark))
    return v.withColumn("ratio_db", F.round("ratio_db", 4))


@query("a18_speech_frames", b.with_tables("blocks", """
  t AS (SELECT session_id, count(*) * 64 AS total FROM blocks GROUP BY 1),
  n AS (SELECT session_id, unnest(range(0, CAST(ceil((total - 1) / 2.75625) AS BIGINT))) AS n FROM t),
  f AS (SELECT session_id, n // 256 AS frame, count(*) AS valid, min(floor(n * 2.75625::DOUBLE + 0.5)::BIGINT) AS start_sample, max(floor(n * 2.75625::DOUBLE + 0.5)::BIGINT) + 1 AS end_sample FROM n GROUP BY ALL)
  SELECT *, frame % 3 / 3.0::DOUBLE > 0.5 AS is_speech FROM f"""))
def a18(spark, sf):
    bl = op.contiguous_blocks(b.blocks(spark, sf), chunk_width(spark))
    frames = op.speech_frames(bl, 44_100)
    scores = frames.select("session_id", "frame", (C("frame") % 3 / F.lit(3.0)).alias("score"))
    return op.label_speech(frames, scores).drop("score")
