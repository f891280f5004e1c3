"""Prompt scripts: comma or tab separated files, or plain lines, to prompt items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.documents import once
from reelspark.session import written

C = F.col

# Accepted column names, compared trimmed and lower-cased.
ID_NAMES = ("id", "编号", "序号", "文本id", "text_id", "item_id")
TEXT_NAMES = ("text", "文本", "内容", "正文", "文案", "sentence", "句子", "句子正文", "唤醒词", "wake", "wakeword", "wake_word")
LABEL_NAMES = ("label", "标签", "要求", "备注", "备注标签", "语气", "强调", "tag")
# The white space an editor trims.
SPACE = ("\t\n\x0B\f\r \u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A"
         "\u2028\u2029\u202F\u205F\u3000\uFEFF")
_CUT = "\uFFFF"


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACE))


def cells(line: Column, delimiter: str) -> Column:
    """Cells of a line; a quote toggles anywhere, a doubled one inside quotes is literal.

    Splitting at the quotes leaves unquoted text at even places. An empty even place
    between two quoted ones is exactly a doubled quote.
    """
    parts = F.split(line, '"')
    last = F.size(parts) - 1

    def mark(part: Column, i: Column) -> Column:
        outside = i % 2 == 0
        return (F.when(outside & (part == "") & (i > 0) & (i < last), '"')
                .when(outside, F.replace(part, F.lit(delimiter), F.lit(_CUT))).otherwise(part))

    plain = F.replace(line, F.lit(delimiter), F.lit(_CUT))
    joined = F.when(F.contains(line, F.lit('"')), F.array_join(F.transform(parts, mark), "")).otherwise(plain)
    return F.transform(F.split(joined, _CUT), trim)


def by_delimiter(line: Column) -> Column:
    return F.when(C("delimiter") == ",", cells(line, ",")).otherwise(cells(line, "\t"))


def read_scripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(C("_metadata.file_path").alias("script_id"), C("value").alias("content"))


def _place(header: Column, names: tuple[str, ...]) -> Column:
    """Zero-based place of the first header cell with one of the names, -1 if none."""
    return F.array_position(F.transform(header, lambda h: h.isin(*names)), True).cast("int") - 1


def _cell(row: Column, place: Column) -> Column:
    return F.coalesce(F.when(place >= 0, F.get(row, place)), F.lit(""))


def script_lines(files: DataFrame) -> DataFrame:
    """Non-blank lines per script, numbered from 1."""
    body = F.regexp_replace(C("content"), "^\uFEFF", "")
    rows = once(files.select("script_id", "content"), "lines", F.filter(F.split(body, r"\r?\n"), lambda x: trim(x) != ""))
    separated = F.exists("lines", lambda x: F.contains(x, F.lit(",")) | F.contains(x, F.lit("\t")))
    return rows.select("script_id", "lines", F.contains(C("content"), F.lit("\t")).alias("tabs"), ~separated,
                       F.size("lines").alias("n_lines")).toDF("script_id", "lines", "tabs", "plain", "n_lines")


def readings(lines: DataFrame) -> DataFrame:
    """The ways to read a separated script: delimiter and the places of its columns.

    A script without tabs has no items when read by tabs, so that reading is left out.
    """
    ways = F.when(C("tabs"), F.array(F.lit(","), F.lit("\t"))).otherwise(F.array(F.lit(",")))
    rows = lines.where(~C("plain") & (C("n_lines") > 0)).select("script_id", "lines", F.explode(ways).alias("delimiter"))
    rows = once(rows, "header", F.transform(by_delimiter(C("lines")[0]), F.lower))
    rows = once(rows, "p", F.struct(_place(C("header"), ID_NAMES).alias("id"), _place(C("header"), TEXT_NAMES).alias("text"),
                                    _place(C("header"), LABEL_NAMES).alias("label")))
    named = (C("p.id") >= 0) | (C("p.text") >= 0)
    at = lambda name, default: F.when(named, C(f"p.{name}")).otherwise(default).alias(f"{name}_at")
    return rows.select("script_id", "lines", "delimiter", named.alias("named"), at("id", 0), at("text", 1), at("label", 2))


def plain_items(lines: DataFrame) -> DataFrame:
    """Plain scripts: the padded line number is the id."""
    rows = lines.where("plain").select("script_id", "n_lines", F.posexplode("lines").alias("i", "line"))
    width = F.greatest(F.lit(4), F.length(C("n_lines").cast("string")))
    number = (C("i") + 1).cast("string")
    return rows.select("script_id", (C("i") + 1).alias("line_no"), F.lpad(number, width, F.lit("0")).alias("item_id"),
                       trim(C("line")).alias("text"), F.lit("").alias("label"))


def parsed_rows(lines: DataFrame) -> DataFrame:
    """Body rows of every reading, each with the line of the first valid use of its id.

    Parsing is the costly part and four later steps use its rows, so they are written once.
    """
    rows = readings(lines).where("id_at >= 0 AND text_at >= 0")
    rows = rows.select("script_id", "delimiter", "named", "id_at", "text_at", "label_at", F.posexplode("lines").alias("i", "line"))
    rows = once(rows.where(~(C("named") & (C("i") == 0))), "row", by_delimiter(C("line")))
    rows = rows.select("script_id", "delimiter", (C("i") + 1).alias("line_no"), _cell(C("row"), C("id_at")).alias("item_id"),
                       _cell(C("row"), C("text_at")).alias("text"), _cell(C("row"), C("label_at")).alias("label"))
    return written(first_use(written(rows, "script-rows")), "script-uses")


def first_use(rows: DataFrame) -> DataFrame:
    """Adds ``first_line``, the first valid row with the same id.

    Rows without an id match nothing; their key is null and they spread over all tasks.
    """
    keys = ["script_id", "delimiter", "key"]
    rows = rows.withColumn("key", F.when(C("item_id") != "", C("item_id")))
    valid = C("key").isNotNull() & (C("text") != "")
    first = rows.where(valid).groupBy(*keys).agg(F.min("line_no").alias("first_line"))
    return rows.join(first, keys, "left").drop("key")


def _row_errors() -> Column:
    codes = F.array(
        F.when(C("item_id") == "", "empty_id"), F.when(C("text") == "", "empty_text"),
        F.when(C("first_line") < C("line_no"), "duplicate_id"))
    return F.array_compact(codes)


def _is_item() -> Column:
    return (C("item_id") != "") & (C("text") != "") & (C("first_line") == C("line_no"))


def _reading_errors(lines: DataFrame) -> DataFrame:
    """Readings with what their header lacks."""
    codes = F.array_compact(F.array(F.when(C("id_at") < 0, "no_id_column"), F.when(C("text_at") < 0, "no_text_column")))
    return readings(lines).select("script_id", "delimiter", codes.alias("codes"))


def choose_delimiter(lines: DataFrame, rows: DataFrame) -> DataFrame:
    """Comma unless its reading has flaws and the tab reading is better."""
    tabbed = F.contains(C("item_id"), F.lit("\t")) | F.contains(C("text"), F.lit("\t")) | F.contains(C("label"), F.lit("\t"))
    body = rows.groupBy("script_id", "delimiter").agg(
        F.count_if(_is_item()).alias("items"), F.sum(F.size(_row_errors())).alias("row_errors"), F.count_if(_is_item() & tabbed).alias("leftover"))
    stats = _reading_errors(lines).join(body, ["script_id", "delimiter"], "left").fillna(0, ["items", "row_errors", "leftover"])
    found = F.size("codes") + C("row_errors")
    errors = F.when((found == 0) & (C("items") == 0), 1).otherwise(found)
    stats = stats.withColumn("errors", errors)
    side = lambda d: F.max(F.when(C("delimiter") == d, F.struct("items", "errors", "leftover")))
    both = stats.groupBy("script_id").agg(side(",").alias("c"), side("\t").alias("t"))
    clean = (C("c.errors") == 0) & (C("c.items") > 0) & (C("c.leftover") == 0)
    tab = (F.when(clean | C("t").isNull() | (C("t.items") == 0), False).when(C("c.items") == 0, True)
           .when(C("t.leftover") != C("c.leftover"), C("t.leftover") < C("c.leftover"))
           .when(C("t.errors") != C("c.errors"), C("t.errors") < C("c.errors")).otherwise(C("t.items") > C("c.items")))
    return both.select("script_id", F.when(tab, "\t").otherwise(",").alias("delimiter"), F.when(tab, C("t.items")).otherwise(C("c.items")).alias("items"),
                       F.when(tab, C("t.errors")).otherwise(C("c.errors")).cast("long").alias("errors"))


def script_items(files: DataFrame) -> DataFrame:
    """script_id, line_no, item_id, text, label of every usable row."""
    lines = script_lines(files)
    rows = parsed_rows(lines)
    chosen = choose_delimiter(lines, rows).select("script_id", "delimiter")
    body = rows.where(_is_item()).join(chosen, ["script_id", "delimiter"], "left_semi")
    return body.select("script_id", "line_no", "item_id", "text", "label").unionByName(plain_items(lines))


def script_errors(files: DataFrame) -> DataFrame:
    """script_id, line_no (null for the whole file), code."""
    lines = script_lines(files)
    rows = parsed_rows(lines)
    chosen = choose_delimiter(lines, rows)
    keep = ["script_id", "delimiter"]
    body = rows.join(chosen.select(*keep), keep, "left_semi").select("script_id", "line_no", F.explode(_row_errors()).alias("code"))
    no_line = F.lit(None).cast("int").alias("line_no")
    header = _reading_errors(lines).join(chosen.select(*keep), keep, "left_semi").select("script_id", no_line, F.explode("codes").alias("code"))
    empty = lines.where("n_lines = 0").select("script_id", no_line, F.lit("empty_file").alias("code"))
    # counted as one error although no row or header raised any
    bare = chosen.where("items = 0").join(header.unionByName(body).select("script_id"), "script_id", "left_anti").select(
        "script_id", no_line, F.lit("no_rows").alias("code"))
    return body.unionByName(header).unionByName(empty).unionByName(bare)
