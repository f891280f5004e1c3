"""WAV sources, cuts and delivery tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.catalog import sessions as cs
from reelspark.operators import delivery as op, fleet, sessions as so, timeline as tl
from reelspark.session import chunk_width
from reelspark.sources import recordings, wav

C = F.col


def _le(value, n):
    """Little-endian hex of a number, n bytes."""
    h = F.lpad(F.hex(value.cast("long").bitwiseAND(F.lit((1 << (8 * n)) - 1))), 2 * n, "0")
    return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])


def wav_files(spark, sf):
    """Every vector as a 16-bit file: some with a stale size, a stray byte or an extra chunk."""
    e = b.table(spark, sf, "embeddings")
    k = C("vec_id") % 7
    pcm = F.array_join(F.transform("embedding", lambda x: _le(F.round(x.cast("double") * 32767), 2)), "")
    data = F.when(k == 3, 108).otherwise(128)
    extra = F.when(k == 5, "4C49535404000000" + "61626364").otherwise("")
    riff = F.lit(36) + data + F.when(k == 5, 12).otherwise(0)
    text = F.concat(F.lit("52494646"), _le(riff, 4), F.lit("57415645666D7420"), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(F.lit(1), 2), _le(F.lit(48000), 4), _le(F.lit(96000), 4),
                    _le(F.lit(2), 2), _le(F.lit(16), 2), extra, F.lit("64617461"), _le(data, 4), pcm, F.when(k == 4, "00").otherwise(""))
    content = F.when(k == 6, F.lit("not a wave file").cast("binary")).otherwise(F.unhex(text))
    f = e.select(F.concat(F.lit("master-"), F.lpad(C("vec_id").cast("string"), 6, "0"), F.lit(".wav")).alias("path"), content.alias("content"))
    return f.select("path", F.length("content").cast("long").alias("length"), "content")


@query("s7_wav_inventory", """
  SELECT 'master-' || lpad(vec_id::VARCHAR, 6, '0') || '.wav' AS path, CASE WHEN vec_id % 7 = 6 THEN 'not_wave' END AS error, CASE WHEN vec_id % 7 < 6 THEN 'riff' END AS container,
     CASE WHEN vec_id % 7 < 6 THEN CASE WHEN vec_id % 7 = 3 THEN 54 ELSE 64 END::BIGINT END AS declared_frames, CASE WHEN vec_id % 7 < 6 THEN 64::BIGINT END AS physical_frames,
     CASE WHEN vec_id % 7 < 6 THEN CASE WHEN vec_id % 7 = 4 THEN 1 ELSE 0 END::BIGINT END AS trailing_bytes, CASE WHEN vec_id % 7 < 6 THEN vec_id % 7 NOT IN (3, 4) END AS exact_header FROM embeddings""")
def s7(spark, sf):
    return wav.inventory(wav_files(spark, sf)).select("path", "error", "container", "declared_frames", "physical_frames", "trailing_bytes", "exact_header")


@query("s8_pcm_blocks", """
  WITH s AS (SELECT 'master-' || lpad(vec_id::VARCHAR, 6, '0') || '.wav' AS path, unnest(range(0, 64)) AS i, round(unnest(embedding)::DOUBLE * 32767) / 32768 AS v FROM embeddings WHERE vec_id % 7 < 6)
  SELECT path, i // 20 * 20 AS block_start, min(i // 20 * 20) + count(*) AS block_end, round(sum(v), 6) AS total FROM s GROUP BY path, i // 20""")
def s8(spark, sf):
    bl = wav.pcm_blocks(wav.inventory(wav_files(spark, sf), keep=("content",)).where("error is null"), 20)
    return bl.select("path", "block_start", "block_end", F.round(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("s4_recording_scan", r"""
  WITH f AS (SELECT 's' || (page_id % 70) AS session_dir, page_id // 70 % 4 AS kind, page_id % 5 AS deep, length(html) AS n, 1000000 + page_id * 10 AS m FROM pages),
  g AS (SELECT *, CASE WHEN kind = 0 THEN 'session.json' WHEN kind = 1 THEN 'metadata' WHEN kind = 2 THEN 'audio' ELSE 'notes.txt' END AS child FROM f WHERE session_dir <> 's3')
  SELECT session_dir, coalesce(max(CASE WHEN child <> 'audio' THEN m END), max(m)) AS modified_at, count(*) AS files, sum(n)::BIGINT AS bytes, CASE WHEN NOT bool_or(child = 'metadata') THEN 'no_metadata' END AS issue
  FROM g GROUP BY 1 HAVING bool_or(child <> 'notes.txt')""")
def s4(spark, sf):
    kind = F.floor(C("page_id") / 70) % 4
    name = F.when(kind == 0, "session.json").when(kind == 1, "metadata/items.snapshot.json").when(kind == 2, "audio/master-000001.wav").otherwise("notes.txt")
    folder = F.when(C("page_id") % 70 == 3, F.lit("/other/s3/")).otherwise(F.concat(F.lit("/rec/s"), (C("page_id") % 70).cast("string"), F.lit("/")))
    files = b.table(spark, sf, "pages").select(F.concat(folder, name).alias("path"), F.length("html").cast("long").alias("length"), (C("page_id") * 10 + 1_000_000).alias("modified_at"))
    return recordings.recording_scan(files, "/rec")


@query("k4_sha256_manifest", """
  WITH x AS (SELECT CASE WHEN page_id % 40 = 1 THEN 'twice' ELSE 'p/' || page_id END AS path, sha256(html) AS sha FROM pages)
  SELECT path, sha || ' *' || path AS line, count(*) OVER (PARTITION BY path) > 1 AS duplicate FROM x""")
def k4(spark, sf):
    p = b.table(spark, sf, "pages")
    return fleet.manifest(p.select(F.when(C("page_id") % 40 == 1, "twice").otherwise(F.concat(F.lit("p/"), C("page_id").cast("string"))).alias("path"), C("html").cast("binary").alias("content")))


# --- cuts: a take at every fifth block, some empty, the last ones beyond the audio ---------

CUTS = """
  bl AS (SELECT session_id, (row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1) * 64 AS bs, samples FROM blocks),
  tk AS (SELECT session_id, bs // 320 AS item_id, bs + 10 AS s, bs + CASE WHEN bs // 320 % 7 = 3 THEN 10 ELSE 160 + bs // 320 % 50 * 10 END AS e FROM bl WHERE bs % 320 = 0),
  sm AS (SELECT session_id, bs + i AS p, v FROM (SELECT session_id, bs, unnest(range(0, 64)) AS i, unnest(samples)::DOUBLE AS v FROM bl)),
  ct AS (SELECT tk.session_id, item_id, s, e, count(v) AS frames, round(sum(v), 6) AS total FROM tk LEFT JOIN sm ON sm.session_id = tk.session_id AND p >= s AND p < e GROUP BY ALL)"""


def cut_inputs(spark, sf):
    """Contiguous blocks and the takes to cut from them."""
    blocks = tl.contiguous_blocks(b.blocks(spark, sf), chunk_width(spark))
    n = F.floor(C("block_start") / 320).cast("long")
    end = F.when(n % 7 == 3, 10).otherwise(n % 50 * 10 + 160)
    takes = blocks.where("block_start % 320 = 0").select("session_id", n.alias("item_id"), (C("block_start") + 10).alias("start_sample"), (C("block_start") + end).alias("end_sample"))
    return takes, op.cut_parts(takes, blocks, 64)


@query("k3_sentence_cuts", b.with_tables("blocks", CUTS + """,
  er AS (SELECT *, CASE WHEN e <= s THEN 'empty_range' WHEN frames <> e - s THEN 'not_covered' END AS error FROM ct)
  SELECT session_id, item_id, 'sentences/' || lpad((item_id + 1)::VARCHAR, 6, '0') || '-' || item_id || '.wav' AS file, frames, error, CASE WHEN error IS NULL THEN 'riff' END AS container,
         CASE WHEN error IS NULL THEN 44 + frames * 3 + frames * 3 % 2 END AS file_bytes FROM er"""))
def k3(spark, sf):
    takes, parts = cut_inputs(spark, sf)
    return op.cut_totals(takes, parts, ["session_id", "item_id"], 24).withColumn("file", op.sentence_file(C("item_id") + 1, C("item_id")))


@query("k3_cut_samples", b.with_tables("blocks", CUTS + " SELECT session_id, item_id, frames, total FROM ct WHERE frames > 0"))
def k3_samples(spark, sf):
    _, parts = cut_inputs(spark, sf)
    return parts.groupBy("session_id", "item_id").agg(F.sum(F.size("samples")).alias("frames"), F.round(F.sum(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)), 6).alias("total"))


# Items stand in the snapshot against the order of their ids, which are text.
ITEM = lambda i: f"'i-' || {i}"
POS = lambda i: f"(99 - {i} % 100 + {i} // 100 * 100)"


def item_id(i):
    return F.concat(F.lit("i-"), i.cast("string"))


def item_pos(i):
    return F.floor(i / 100) * 100 + 99 - i % 100


@query("k1_delivery_csv", b.with_tables("takes items", cs.CHOSEN + f'''
  SELECT DISTINCT i.session_id, 0::BIGINT AS line_no, '{','.join(op.CSV_COLUMNS)}' AS line FROM chosen c JOIN items i USING (item_id) UNION ALL
  SELECT i.session_id, row_number() OVER (PARTITION BY i.session_id ORDER BY {POS('c.item_id')}) AS line_no, '"' || {ITEM('c.item_id')} || '","say ""' || c.item_id || '""","' || i.label || '","' || c.attempt_id || '",' || start_sample || ',' || recording_started_sample || ',0,' || head_silence_passed_sample || ',24000,' || content_started_sample || ','
     || printf('%.6f', content_started_sample / 48000) || ',' || end_sample || ',' || (end_sample - start_sample) || ',"sentences/' || lpad({POS('c.item_id')}::VARCHAR, 6, '0') || '-' || {ITEM('c.item_id')} || '.wav",' || forced_without_tail_silence::VARCHAR || ',' || coalesce(tail_silence_samples, 0) || ',24000' AS line
  FROM chosen c JOIN items i USING (item_id)'''))
def k1(spark, sf):
    return op.csv_lines(delivery_rows(spark, sf), chunk_width(spark))


def delivery_rows(spark, sf):
    t = lambda n: C(f"take.{n}")
    rows = cs.chosen(spark, sf).join(b.items(spark, sf).select("session_id", "item_id", "label"), "item_id")
    pos, key = item_pos(C("item_id")), item_id(C("item_id"))
    return rows.select(
        "session_id", pos.alias("pos"), key.alias("id"), F.concat(F.lit('say "'), C("item_id").cast("string"), F.lit('"')).alias("text"), "label",
        *[t(n).alias(n) for n in ("attempt_id", "start_sample", "recording_started_sample", "head_silence_passed_sample", "required_head_silence_samples", "content_started_sample",
                                  "end_sample", "forced_without_tail_silence", "tail_silence_samples", "required_tail_silence_samples")],
        F.lit(-1).alias("head_silence_armed_sample"), (t("content_started_sample") / F.lit(48000.0)).alias("content_started_seconds"),
        (t("end_sample") - t("start_sample")).alias("duration_samples"), op.sentence_file(pos, key).alias("file"))


@query("k2_delivery_json", b.with_tables("candidates items", cs.LATEST + f""",
  x AS (SELECT session_id, {POS('item_id')} AS pos, {POS('item_id')} // 1000 AS part, status = 'accepted' AS ex, '{{"pos":' || {POS('item_id')} || ',"id":"' || {ITEM('item_id')} || '","attempt_id":"' || selected_attempt_id || '"}}' AS j FROM items),
  g AS (SELECT session_id, part, count_if(ex)::INTEGER AS n_exported, count_if(NOT ex)::INTEGER AS n_skipped, coalesce(string_agg(j, ',' ORDER BY pos) FILTER (WHERE ex), '') AS e,
        coalesce(string_agg(j, ',' ORDER BY pos) FILTER (WHERE NOT ex), '') AS k, string_agg(j, ',' ORDER BY pos) AS a FROM x GROUP BY ALL)
  SELECT g.session_id, part, n_exported, n_skipped, '{{"source":{{' || coalesce('"journal_seq":' || journal_seq || ',"committed_samples":' || committed_samples || ',', '') || '"selected_attempts":[' || a || ']}},"exported":[' || e || '],"skipped":[' || k || ']}}' AS document
  FROM g LEFT JOIN latest l ON l.session_dir = g.session_id"""))
def k2(spark, sf):
    i = b.items(spark, sf).select("session_id", item_pos(C("item_id")).alias("pos"), item_id(C("item_id")).alias("item_id"), C("selected_attempt_id").alias("attempt_id"), (C("status") == "accepted").alias("exported"))
    source = so.latest_snapshot(b.candidates(spark, sf)).select(C("session_dir").alias("session_id"), "journal_seq", "committed_samples")
    return op.manifest_parts(i, source, 1000)


@query("w3_export_peak_space", """
  WITH s AS (SELECT o_custkey AS export_id, o_orderkey AS step, floor(o_totalprice)::BIGINT * 1000 AS n, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE floor(o_totalprice)::BIGINT * 900 END AS r FROM orders),
  c AS (SELECT export_id, sum(n) OVER w - coalesce(sum(r) OVER (PARTITION BY export_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS extra FROM s WINDOW w AS (PARTITION BY export_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
  p AS (SELECT export_id, greatest(0, max(extra))::BIGINT AS pk FROM c GROUP BY 1)
  SELECT export_id, pk AS peak_additional_bytes, pk + 1073741824 AS required_available_bytes, 2000000000 + export_id * 1000 >= pk + 1073741824 AS can_export FROM p""")
def w3(spark, sf):
    price = F.floor("o_totalprice").cast("long")
    s = b.table(spark, sf, "orders").select(
        C("o_custkey").alias("export_id"), C("o_orderkey").alias("step"), (price * 1000).alias("new_bytes"), F.when(C("o_orderkey") % 3 == 0, 0).otherwise(price * 900).alias("replaced_bytes"),
        (C("o_custkey") * 1000 + 2_000_000_000).alias("available_bytes"))
    return op.export_peak(s, chunk_width(spark), 1024**3)


@query("c8_delivery_manifest_coherent", b.with_tables("candidates items", cs.DELIVERY + """,
  n AS (SELECT session_id, count(*) AS total, count_if(status = 'accepted') AS ex, bool_and(item_id % 90 <> 1) AS names FROM items GROUP BY 1),
  f AS (SELECT s.session_id, s.session_id % 17 > 0 AND s.session_id % 19 > 0 AS c1, s.session_id % 5 > 0 AND coalesce(selections_equal, false) AS c2, s.session_id % 11 > 0 AS c3, names AS c4 FROM snap s LEFT JOIN eq USING (session_id) JOIN n ON n.session_id = s.session_id)
  SELECT session_id, check_id, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT session_id, unnest(['manifest-status', 'manifest-source', 'manifest-counts', 'manifest-files']) AS check_id, unnest([c1, c2, c3, c4]) AS ok FROM f)"""))
def c8(spark, sf):
    snap, _, eq = cs.delivery_inputs(spark, sf)
    i = b.items(spark, sf).select("session_id", "item_id", "status", op.sentence_file(C("item_id"), C("item_id")).alias("name"))
    n = i.groupBy("session_id").agg(F.count(F.lit(1)).alias("total_items"), F.count_if(C("status") == "accepted").alias("exported"))
    names = fleet.name_sets_equal(i, i.where("item_id % 90 <> 1"), "session_id")
    s = C("session_id")
    f = snap.join(eq, "session_id", "left").join(n, "session_id").join(names, "session_id").select(
        "*", F.when(s % 17 == 0, 1).otherwise(2).alias("bundle_version"), F.when(s % 19 == 0, "running").otherwise("complete").alias("bundle_status"), s.alias("bundle_session_id"),
        (C("journal_seq") - F.when(s % 5 == 0, 1).otherwise(0)).alias("source_seq"), C("committed_samples").alias("source_committed"),
        (C("total_items") - C("exported")).alias("skipped"), (C("exported") + (s % 11 == 0).cast("int")).alias("status_exported"))
    return op.manifest_checks(f)
