"""Logs, redaction and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.functions import identity, text as t
from reelspark.sources import logs

C = F.col

# One JSON log line per event; store = user, some lines damaged or incomplete.
LOG_SQL = """
  raw AS (SELECT session_id AS store, seq, k, phase, value, CASE WHEN k = 7 THEN '{"seq":' ELSE '{"seq":' || CASE WHEN k = 8 THEN '0' WHEN k = 9 THEN '"x"' ELSE seq::VARCHAR END || ',"ts":"' || CASE WHEN k = 10 THEN ' ' ELSE 't' || seq END
     || '","level":"' || CASE phase WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'click' THEN 'trace' ELSE 'debug' END || '","category":"' || CASE WHEN k % 5 = 0 THEN '' ELSE repeat('c', k) END
     || '","event":"' || CASE WHEN k = 11 THEN ' ' ELSE phase END || '","message":"' || CASE WHEN k = 12 THEN repeat('m', 2100) || ' value 3' ELSE 'value ' || k END || '"' || CASE WHEN k % 4 = 0 THEN ',"session_id":" s' || session_id || ' "' ELSE '' END
     || CASE WHEN k % 3 = 0 THEN ',"data":{"k":' || k || '}' WHEN k % 3 = 1 THEN ',"data":[1]' ELSE ',"data":{}' END || '}' END AS text FROM telemetry),
  logs AS (SELECT store, seq, 't' || seq AS ts, CASE phase WHEN 'error' THEN 'error' WHEN 'view' THEN 'warn' WHEN 'click' THEN 'info' ELSE 'debug' END AS level, 'ui' AS source,
     CASE WHEN k % 5 = 0 THEN 'app' ELSE left(repeat('c', k), 40) END AS category, phase AS event, CASE WHEN k = 12 THEN repeat('m', 2000) || '…[truncated 108]' ELSE 'value ' || k END AS message,
     CASE WHEN k % 5 = 0 THEN 'app' ELSE repeat('c', k) END AS full_category, phase AS full_event, CASE WHEN k = 12 THEN repeat('m', 2100) || ' value 3' ELSE 'value ' || k END AS full_message,
     CASE WHEN k % 4 = 0 THEN 's' || store END AS session_id, CASE WHEN k % 3 = 0 THEN '{"k":' || k || '}' WHEN k % 3 = 2 THEN '{}' END AS data
     FROM raw WHERE k NOT BETWEEN 7 AND 11 AND seq > 0)"""


def log_lines(spark, sf):
    e = b.telemetry(spark, sf)
    k, seq = C("k"), C("seq").cast("string")
    level = F.when(C("phase") == "error", "error").when(C("phase") == "view", "warn").when(C("phase") == "click", "trace").otherwise("debug")
    text = F.concat(
        F.lit('{"seq":'), F.when(k == 8, "0").when(k == 9, '"x"').otherwise(seq), F.lit(',"ts":"'), F.when(k == 10, " ").otherwise(F.concat(F.lit("t"), seq)),
        F.lit('","level":"'), level, F.lit('","category":"'), F.when(k % 5 == 0, "").otherwise(F.repeat(F.lit("c"), k)),
        F.lit('","event":"'), F.when(k == 11, " ").otherwise(C("phase")), F.lit('","message":"'),
        F.when(k == 12, F.concat(F.repeat(F.lit("m"), F.lit(2100)), F.lit(" value 3"))).otherwise(F.concat(F.lit("value "), k.cast("string"))), F.lit('"'),
        F.when(k % 4 == 0, F.concat(F.lit(',"session_id":" s'), C("session_id").cast("string"), F.lit(' "'))).otherwise(""),
        F.when(k % 3 == 0, F.concat(F.lit(',"data":{"k":'), k.cast("string"), F.lit("}"))).when(k % 3 == 1, ',"data":[1]').otherwise(',"data":{}'), F.lit("}"))
    return e.select(C("session_id").alias("store"), F.when(k == 7, '{"seq":').otherwise(text).alias("text"))


def entries(spark, sf):
    return logs.parse_log(log_lines(spark, sf))


def oracle(body):
    return b.with_tables("telemetry", LOG_SQL + body)


@query("s11_log_read", oracle(" SELECT * FROM logs"))
def s11(spark, sf):
    return entries(spark, sf)


@query("p9_log_search", oracle("""
  SELECT store, seq FROM logs WHERE level IN ('warn', 'error') AND contains(lower(ts || ' ' || level || ' ' || source || ' ' || full_category || ' ' || full_event || ' ' || full_message || ' ' || coalesce(session_id, '') || ' ' || coalesce(data, '')), 'value 3')"""))
def p9(spark, sf):
    return logs.search(entries(spark, sf), "warn", "Value 3").select("store", "seq")


@query("w18_last_n_log", oracle(" SELECT store, seq FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq DESC) AS r FROM logs) WHERE r <= 20"))
def w18(spark, sf):
    return logs.newest(entries(spark, sf), 20).select("store", "seq")


@query("w18_dropped_count", oracle(" SELECT store, least(count(*), 20) AS kept, greatest(count(*) - 20, 0) AS dropped FROM logs GROUP BY 1"))
def w18_dropped(spark, sf):
    return logs.kept_and_dropped(entries(spark, sf), 20)


@query("k5_log_text", oracle("""
  SELECT ts || '  ' || rpad(upper(level), 5, ' ') || '  ' || source || '/' || category || '  ' || event || '  ' || message || CASE WHEN session_id IS NOT NULL THEN '  session=' || session_id ELSE '' END
     || CASE WHEN data <> '{}' THEN '  ' || data ELSE '' END AS line FROM logs"""))
def k5(spark, sf):
    return entries(spark, sf).select(logs.log_line().alias("line"))


@query("u6_union_log_stores", oracle("""
  SELECT 'app' AS origin, store, seq FROM logs WHERE session_id IS NULL UNION ALL SELECT 'session', store, seq FROM logs WHERE session_id IS NOT NULL"""))
def u6(spark, sf):
    e = entries(spark, sf)
    app = e.where("session_id is null").drop("session_id").withColumn("origin", F.lit("app"))
    return logs.union_stores(app, e.where("session_id is not null").withColumn("origin", F.lit("session"))).select("origin", "store", "seq")


# Documents with ids and paths planted between their words.
PLANT = """
  d AS (SELECT doc_id, replace(replace(replace(text, ' de ', ' C:\\Users\\x\\a.wav '), ' the ', ' (/home/u/f' || doc_id || ') '), ' der ', ' 0A1b2c3d-0000-4000-8000-00000000abcd ') AS text FROM documents)"""


def planted(spark, sf):
    d = b.table(spark, sf, "documents")
    rep = lambda c, x, y: F.replace(c, F.lit(x), y if not isinstance(y, str) else F.lit(y))
    x = rep(C("text"), " de ", " C:\\Users\\x\\a.wav ")
    x = rep(x, " the ", F.concat(F.lit(" (/home/u/f"), C("doc_id").cast("string"), F.lit(") ")))
    return d.select("doc_id", rep(x, " der ", " 0A1b2c3d-0000-4000-8000-00000000abcd ").alias("text"))


@query("p17_redact_strings", f"""
  WITH {PLANT} SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '{t.UUID}', '[RecordingId]', 'g'), '{t.WINDOWS_PATH}', '[LocalPath]', 'g'), '{t.POSIX_PATH.replace("'", "''")}', '\\1[LocalPath]', 'g') AS text FROM d""")
def p17(spark, sf):
    return planted(spark, sf).select("doc_id", t.redact(C("text")).alias("text"))


@query("p18_redact_keys", r"""
  SELECT doc_id, '{"api_token":"[Filtered]","at":' || doc_id || ',"list":["in [LocalPath] now",{"deep":[{"password":"[Filtered]","path":"[LocalPath]"}],"ok":true},null],"mytext":"' || lang
     || '","nested":{"secret":"[Filtered]","token":"[Filtered]"},"session_id":"[Filtered]","source":"' || source || '"}' AS data FROM documents""")
def p18(spark, sf):
    d = b.table(spark, sf, "documents")
    key = C("doc_id").cast("string")
    raw = F.concat(F.lit('{"source":"'), C("source"), F.lit('","api_token":"x'), key, F.lit('","session_id":"s1","mytext":"'), C("lang"), F.lit('","at":'), key,
                   F.lit(',"nested":{"token":"S"  ,"secret":{"a":[1,'), key, F.lit(']}},"list":["in /tmp/a/b now",{"deep":[{"password":"P","path":"/tmp/f'), key, F.lit('"}],"ok":true},null]}'))
    return d.select("doc_id", t.redact_json(F.to_json(F.parse_json(raw))).alias("data"))


@query("p19_summarise_payload", """
  SELECT doc_id, length(text) AS chars, left(text, 240) || CASE WHEN length(text) > 240 THEN '…[truncated ' || (length(text) - 240) || ']' ELSE '' END AS body, 3 AS items,
         '[' || left(text, 20) AS note, '{"content":"[omitted]","deep":{"deeper":{"deepest":"[Nested]"}},"many":{"length":15,"preview":[0,1,2,3,4,5,6,7]},"n":' || doc_id || ',"none":null}' AS nested FROM documents""")
def p19(spark, sf):
    d = b.table(spark, sf, "documents")
    nested = F.concat(F.lit('{"content":{"a":1},"deep":{"deeper":{"deepest":{"x":[1]}}},"many":[0,1,2,3,4,5,6,7,8,9,10,11,12,13,14],"none":null,"n":'), C("doc_id").cast("string"), F.lit("}"))
    doc = F.to_json(F.struct("text", C("text").alias("body"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("items"), F.concat(F.lit("["), F.left("text", F.lit(20))).alias("note")))
    whole = F.concat(F.expr("left(doc, length(doc) - 1)"), F.lit(',"nested":'), nested, F.lit("}"))
    m = d.select("doc_id", doc.alias("doc")).select("doc_id", t.summarise_value(F.parse_json(whole)).alias("m"))
    get = lambda path, kind: F.try_variant_get("m", path, kind)
    return m.select("doc_id", get("$.text.chars", "long").alias("chars"), get("$.body", "string").alias("body"), get("$.items.length", "int").alias("items"),
                    get("$.note", "string").alias("note"), F.to_json(get("$.nested", "variant")).alias("nested"))


@query("f25_text_clamp", """
  SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '…[truncated ' || (length(text) - 100) || ']' ELSE text END AS text FROM documents""")
def f25(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", t.clamp(C("text"), 100).alias("text"))


@query("f20_csv_cell", """SELECT doc_id, '"' || replace(text, '"', '""') || '"' AS cell FROM documents""")
def f20(spark, sf):
    return b.table(spark, sf, "documents").select("doc_id", t.csv_cell(C("text")).alias("cell"))


@query("f17_delivered_name", r"""
  WITH x AS (SELECT page_id, left(regexp_replace(regexp_replace(url || CASE WHEN page_id % 3 = 0 THEN ' .' ELSE '' END, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '[. ]+$', ''), 80) AS n FROM pages),
  y AS (SELECT page_id, n, row_number() OVER (PARTITION BY n ORDER BY page_id) - 1 AS c FROM x)
  SELECT page_id, n || '-full-track-20240102-030405' || CASE WHEN c > 0 THEN '-' || (c + 1) ELSE '' END || '.wav' AS name FROM y""")
def f17(spark, sf):
    p = b.table(spark, sf, "pages").select("page_id", F.concat(C("url"), F.when(C("page_id") % 3 == 0, " .").otherwise("")).alias("raw"))
    return delivered(p)


def delivered(p):
    """Equal names are numbered; a name's collisions are ranked by a chunked count."""
    from reelspark.operators.scan import Scan, chunk_of, scan
    p = p.withColumn("safe", identity.safe_name(C("raw"))).withColumn("chunk", chunk_of("page_id", 65536))
    p = scan(p, ["safe"], ["page_id"], "chunk", Scan(total={"collision": F.lit(1).cast("long")}))
    stamp = F.date_format(F.to_timestamp_ntz(F.lit("2024-01-02 03:04:05")), "yyyyMMdd-HHmmss")
    return p.select("page_id", identity.delivered_name(C("raw"), F.lit("full-track"), stamp, C("collision"), F.lit(".wav")).alias("name"))


@query("p15_fault_title", b.with_tables("telemetry", f"""
  SELECT session_id, seq, CASE trim(coalesce(fault_kind, '')) WHEN 'device_unavailable' THEN '{t.FAULT_TITLES["device_unavailable"]}' WHEN 'input_stream_error' THEN '{t.FAULT_TITLES["input_stream_error"]}' ELSE '{t.OTHER_FAULT_TITLE}' END AS title
  FROM telemetry WHERE faulted"""))
def p15(spark, sf):
    return b.telemetry(spark, sf).where("faulted").select("session_id", "seq", t.fault_title(C("fault_kind")).alias("title"))


RAW_ERRORS = ("open 0x8889000A", "EXCLUSIVE_MODE_NOT_ALLOWED", "未枚举到独占格式", "unsupported_format x", "独占开流失败", "some Exclusive thing", "activation stage init failed", "other")


@query("p16_error_class", """
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'exclusive_busy' WHEN 1 THEN 'exclusive_policy' WHEN 2 THEN 'exclusive_empty' WHEN 3 THEN 'exclusive_format' WHEN 4 THEN 'exclusive_open' WHEN 5 THEN 'exclusive_open' WHEN 6 THEN 'activation' ELSE 'generic' END AS kind FROM events""")
def p16(spark, sf):
    raw = F.get(F.array(*[F.lit(x) for x in RAW_ERRORS]), (C("event_id") % 8).cast("int"))
    return b.table(spark, sf, "events").select("event_id", t.error_class(F.concat(raw, C("props"))).alias("kind"))


@query("p20_warning_split", """
  SELECT doc_id, (doc_id % 3 > 0)::INTEGER AS benign, (CASE WHEN length(trim(text)) > 0 THEN 1 ELSE 0 END + 1)::INTEGER AS serious FROM documents""")
def p20(spark, sf):
    d = b.table(spark, sf, "documents")
    seq = F.when(C("doc_id") % 3 > 0, "journal_seq=4").otherwise("seq=4")
    ws = F.array(F.concat(F.lit(t.REPLAYED_SNAPSHOT + " "), seq), C("text"), F.when(C("doc_id") % 3 > 0, "disk").otherwise(" "))
    return d.select("doc_id", t.split_warnings(ws).alias("w")).select("doc_id", F.size("w.benign").alias("benign"), F.size("w.serious").alias("serious"))


@query("p22_quiet_success", b.with_tables("telemetry", """
  SELECT session_id, seq FROM telemetry WHERE NOT (k < 70 AND phase = 'view')"""))
def p22(spark, sf):
    cmd = F.when(C("phase") == "view", "get_state").otherwise(C("phase"))
    return b.telemetry(spark, sf).where(t.logged_command(cmd, C("k") < 70)).select("session_id", "seq")
