"""Script ingest over the documents table."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspark.catalog import query
from reelspark.catalog import bindings as b
from reelspark.sources import scripts as src

C = F.col
TAB = "\t"

# Documents as script files: raw, with headers, tab separated, or with quoted cells.
FILES = f"""
  files AS (SELECT doc_id AS script_id, CASE doc_id % 6
    WHEN 0 THEN text WHEN 1 THEN 'ID, Text ,tag' || chr(10) || text WHEN 2 THEN replace(text, ' de ', chr(9)) WHEN 3 THEN 'text' || chr(9) || 'item_id' || chr(10) || replace(replace(text, '. ', chr(9)), ' ', chr(9))
    WHEN 4 THEN chr(65279) || replace(replace(text, ' en ', ' "en, ""x"" en" '), ' the ', ' "the, y') ELSE 'label,id' || chr(10) || chr(10) || text END AS content FROM documents)"""


def files(spark, sf):
    d = b.table(spark, sf, "documents")
    t, k = C("text"), C("doc_id") % 6
    rep = lambda c, x, y: F.replace(c, F.lit(x), F.lit(y))
    content = (F.when(k == 0, t).when(k == 1, F.concat(F.lit("ID, Text ,tag\n"), t)).when(k == 2, rep(t, " de ", TAB))
               .when(k == 3, F.concat(F.lit("text\titem_id\n"), rep(rep(t, ". ", TAB), " ", TAB)))
               .when(k == 4, F.concat(F.lit("\uFEFF"), rep(rep(t, " en ", ' "en, ""x"" en" '), " the ", ' "the, y')))
               .otherwise(F.concat(F.lit("label,id\n\n"), t)))
    return d.select(C("doc_id").alias("script_id"), content.alias("content"))


SP = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def _names(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


PARSE = FILES + f""",
  ln AS (SELECT script_id, list_filter(regexp_split_to_array(regexp_replace(content, '^\\x{{FEFF}}', ''), '\\r?\\n'), lambda x: {_trim('x')} <> '') AS lines FROM files),
  fl AS (SELECT *, len(list_filter(lines, lambda x: contains(x, ',') OR contains(x, chr(9)))) = 0 AS plain FROM ln WHERE len(lines) > 0),
  rd AS (SELECT script_id, d, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM fl, (VALUES (','), (chr(9))) v(d) WHERE NOT plain),
  pt AS (SELECT script_id, d, line_no, string_split(line, '"') AS p FROM rd),
  ce AS (SELECT script_id, d, line_no, list_transform(string_split(array_to_string(list_transform(range(1, len(p) + 1),
            lambda i: CASE WHEN i % 2 = 1 AND p[i] = '' AND i > 1 AND i < len(p) THEN '"' WHEN i % 2 = 1 THEN replace(p[i], d, chr(65535)) ELSE p[i] END), ''), chr(65535)), lambda x: {_trim('x')}) AS c FROM pt),
  hd AS (SELECT script_id, d, list_transform(c, lambda x: lower(x)) AS h FROM ce WHERE line_no = 1),
  hp AS (SELECT script_id, d, coalesce(list_position(list_transform(h, lambda x: list_contains({_names(src.ID_NAMES)}, x)), true), 0) AS hi,
                coalesce(list_position(list_transform(h, lambda x: list_contains({_names(src.TEXT_NAMES)}, x)), true), 0) AS ht,
                coalesce(list_position(list_transform(h, lambda x: list_contains({_names(src.LABEL_NAMES)}, x)), true), 0) AS hl FROM hd),
  hx AS (SELECT script_id, d, hi > 0 OR ht > 0 AS named, CASE WHEN hi > 0 OR ht > 0 THEN hi ELSE 1 END AS i, CASE WHEN hi > 0 OR ht > 0 THEN ht ELSE 2 END AS t, CASE WHEN hi > 0 OR ht > 0 THEN hl ELSE 3 END AS l FROM hp),
  bd AS (SELECT script_id, d, line_no, coalesce(c[i], '') AS item_id, coalesce(c[t], '') AS text, CASE WHEN l > 0 THEN coalesce(c[l], '') ELSE '' END AS label
         FROM ce JOIN hx USING (script_id, d) WHERE i > 0 AND t > 0 AND NOT (named AND line_no = 1)),
  fu AS (SELECT *, min(CASE WHEN item_id <> '' AND text <> '' THEN line_no END) OVER (PARTITION BY script_id, d, item_id) AS fl FROM bd),
  rw AS (SELECT *, item_id <> '' AND text <> '' AND fl = line_no AS is_item, item_id <> '' AND coalesce(fl < line_no, false) AS dup FROM fu),
  st0 AS (SELECT script_id, d, count_if(is_item) AS items, sum((item_id = '')::INT + (text = '')::INT + dup::INT) AS re,
                 count_if(is_item AND (contains(item_id, chr(9)) OR contains(text, chr(9)) OR contains(label, chr(9)))) AS left_tabs FROM rw GROUP BY ALL),
  st AS (SELECT script_id, d, coalesce(items, 0) AS items, coalesce(left_tabs, 0) AS left_tabs, (i <= 0)::INT + (t <= 0)::INT + coalesce(re, 0) AS e FROM hx LEFT JOIN st0 USING (script_id, d)),
  se AS (SELECT *, CASE WHEN e = 0 AND items = 0 THEN 1 ELSE e END AS errors FROM st),
  ch AS (SELECT c.script_id, CASE WHEN c.errors = 0 AND c.items > 0 AND c.left_tabs = 0 THEN ',' WHEN t.items = 0 THEN ',' WHEN c.items = 0 THEN chr(9)
              WHEN t.left_tabs < c.left_tabs THEN chr(9) WHEN t.left_tabs > c.left_tabs THEN ',' WHEN t.errors < c.errors THEN chr(9) WHEN t.errors = c.errors AND t.items > c.items THEN chr(9) ELSE ',' END AS d
         FROM se c JOIN se t ON c.script_id = t.script_id AND c.d = ',' AND t.d = chr(9))"""


def oracle(body: str) -> str:
    return f"WITH {PARSE.strip()} {body}"


PLAIN = f"""SELECT script_id, line_no::INTEGER AS line_no, lpad(line_no::VARCHAR, greatest(4, length(n::VARCHAR))::INTEGER, '0') AS item_id, {_trim('line')} AS text, '' AS label
  FROM (SELECT script_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no, len(lines) AS n FROM fl WHERE plain)"""


@query("s1_script_ingest", oracle(f"""
  SELECT script_id, line_no::INTEGER AS line_no, item_id, text, label FROM rw JOIN ch USING (script_id, d) WHERE is_item UNION ALL {PLAIN}"""))
def s1(spark, sf):
    return src.script_items(files(spark, sf))


@query("s1_script_errors", oracle("""
  , er AS (SELECT script_id, line_no::INTEGER AS line_no, 'empty_id' AS code FROM rw JOIN ch USING (script_id, d) WHERE item_id = ''
  UNION ALL SELECT script_id, line_no, 'empty_text' FROM rw JOIN ch USING (script_id, d) WHERE text = ''
  UNION ALL SELECT script_id, line_no, 'duplicate_id' FROM rw JOIN ch USING (script_id, d) WHERE dup
  UNION ALL SELECT script_id, NULL::INTEGER, 'no_id_column' FROM hx JOIN ch USING (script_id, d) WHERE i <= 0
  UNION ALL SELECT script_id, NULL, 'no_text_column' FROM hx JOIN ch USING (script_id, d) WHERE t <= 0)
  SELECT script_id, line_no::INTEGER AS line_no, code FROM er UNION ALL SELECT script_id, NULL, 'empty_file' FROM ln WHERE len(lines) = 0
  UNION ALL SELECT script_id, NULL, 'no_rows' FROM st JOIN ch USING (script_id, d) WHERE e = 0 AND items = 0"""))
def s1_errors(spark, sf):
    return src.script_errors(files(spark, sf))


@query("s2_delimiter_choice", oracle("""
  SELECT ch.script_id, ch.d AS delimiter, items::BIGINT AS items, errors::BIGINT AS errors FROM ch JOIN se USING (script_id, d)"""))
def s2(spark, sf):
    lines = src.script_lines(files(spark, sf))
    return src.choose_delimiter(lines, src.parsed_rows(lines))


@query("s3_plain_text_ids", oracle(PLAIN))
def s3(spark, sf):
    return src.plain_items(src.script_lines(files(spark, sf)))


@query("w20_duplicate_item_id", oracle("SELECT script_id, d AS delimiter, line_no::INTEGER AS line_no, item_id FROM rw WHERE dup"))
def w20(spark, sf):
    rows = src.parsed_rows(src.script_lines(files(spark, sf)))
    return rows.where("first_line < line_no").select("script_id", "delimiter", "line_no", "item_id")
