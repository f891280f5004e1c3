"""Log lines, redaction and error classes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, key names and titles.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
WINDOWS_PATH = r'\b[A-Za-z]:\\(?:[^\s\\/:*?"<>|]+\\)*[^\s\\/:*?"<>|]*'
POSIX_PATH = r"""(^|[\s"'`(])/(?:Users|home|Volumes|private|tmp|var|opt|mnt)/[^\s"'`)]+"""
SENSITIVE_KEY = (r"(?i)(?:^|[_-])(?:authorization|cookie|dsn|password|secret|token|ticket|license|machine(?:[_-]?code)?|"
                 r"script(?:[_-]?name)?|text|content|session[_-]?(?:id|dir)|file[_-]?path|output[_-]?root)(?:$|[_-])")
BULKY_KEY = r"(?i)^(?:items|waveform|content|text|script_items|samples)$"
FAULT_TITLES = {
    "device_unavailable": "所选声卡已断开或不可用",
    "device_stalled": "声卡已停止输送音频",
    "input_discontinuity": "音频输入出现不连续",
    "input_stream_error": "音频输入流故障",
}
OTHER_FAULT_TITLE = "音频采集已触发数据保护"
QUIET_COMMANDS = ("get_state", "get_state_optional", "hello", "dev_feed_pcm")
# Error classes, first match wins.
ERROR_RULES = (
    (r"(?i)0x8889000[aA]|声卡正被其他程序独占使用|DEVICE_IN_USE", "exclusive_busy"),
    (r"(?i)0x8889000[eE]|系统策略不允许该设备使用独占|EXCLUSIVE_MODE_NOT_ALLOWED", "exclusive_policy"),
    (r"(?i)未枚举到独占格式|exclusive_empty", "exclusive_empty"),
    (r"(?i)0x88890008|不支持所选采样率|不支持采集格式|UNSUPPORTED_FORMAT|独占模式：所选设备", "exclusive_format"),
    (r"(?i)0x8889000[fF]|独占开流失败|无法以独占模式创建采集端点|ENDPOINT_CREATE_FAILED", "exclusive_open"),
    (r"(?i)独占|exclusive|0x8889", "exclusive_open"),
    (r"(?i)activation stage \S+ failed", "activation"),
)
REPLAYED_SNAPSHOT, REPLAYED_SEQ = "最终快照不可用或不是最新", "journal_seq"
LEVELS = ("debug", "info", "warn", "error")
SOURCES = ("ui", "main", "engine", "ipc")
CATEGORY_CAP, EVENT_CAP, MESSAGE_CAP, TEXT_CAP = 40, 80, 2000, 240
ARRAY_CAP, PREVIEW, DEPTH_CAP = 12, 8, 4
FILTERED = "[Filtered]"


def clamp(x: Column, n: int) -> Column:
    cut = F.concat(F.substring(x, 1, n), F.lit("…[truncated "), (F.length(x) - n).cast("string"), F.lit("]"))
    return F.when(F.length(x) > n, cut).otherwise(x)


def redact(x: Column) -> Column:
    """Masks recording ids and local paths."""
    x = F.regexp_replace(x, UUID, "[RecordingId]")
    x = F.regexp_replace(x, WINDOWS_PATH, "[LocalPath]")
    return F.regexp_replace(x, POSIX_PATH, "$1[LocalPath]")


def _string(x: Column) -> Column:
    return x.cast("variant")


def _walk(v: Column, inner: Callable[[Column, Column], Column], rebuilt: Callable[[Column, Column], Column]) -> Column:
    """A container with ``inner(key, value)`` in place of each value; elements of an array have the key ''.

    Objects and arrays share one expression, so that nesting it makes the plan grow by one step a level.
    """
    array = F.schema_of_variant(v).startswith("ARRAY")
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.struct(F.lit("").alias("key"), x.alias("value")))
    entries = F.when(array, listed).otherwise(F.map_entries(F.try_variant_get(v, "$", "map<string,variant>")))
    done = F.transform(entries, lambda e: F.struct(e["key"].alias("key"), inner(e["key"], e["value"]).alias("value")))
    return F.get(F.transform(F.array(done), lambda x: rebuilt(array, x)), 0)  # bound to a name: written out, it would double at every level


def _container(array: Column, entries: Column) -> Column:
    return F.when(array, F.to_variant_object(F.transform(entries, lambda e: e["value"]))).otherwise(F.to_variant_object(F.map_from_entries(entries)))


_JSON_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s{}\[\],:"]+')


def _redact_text(x: str) -> str:
    """``redact`` of one string."""
    return re.sub(POSIX_PATH, r"\1[LocalPath]", re.sub(WINDOWS_PATH, "[LocalPath]", re.sub(UUID, "[RecordingId]", x)))


def _redact_document(doc: str) -> str:
    """One pass over the tokens of a JSON document; the only thing that grows with its depth is the list of open containers."""
    out, open_, hidden, key_next, mask, filtered = [], [], 0, False, False, f'"{FILTERED}"'
    for token in (m[0] for m in _JSON_TOKEN.finditer(doc)):
        if hidden:  # within a masked container
            hidden += (token in "{[") - (token in "}]")
        elif token in "{[":
            if mask:
                out.append(filtered)
                hidden, mask = 1, False
            else:
                open_.append(token)
                out.append(token)
                key_next = token == "{"
        elif key_next and token[0] == '"':
            out.append(token)
            mask, key_next = re.search(SENSITIVE_KEY, json.loads(token)) is not None, False
        elif token in "}],:":
            out.append(token)
            if token in "}]":
                open_.pop()
            key_next = token == "," and open_[-1] == "{"
        else:
            if mask:
                token = filtered
            elif token[0] == '"':
                plain = json.loads(token)
                token = token if (safe := _redact_text(plain)) == plain else json.dumps(safe, ensure_ascii=False)
            out.append(token)
            mask = False
    return "".join(out)


def redact_json(doc: Column) -> Column:
    """Masks the values of sensitive keys at any depth of a JSON document and redacts all other strings; null stays null.

    A Python helper in Arrow batches: SQL expressions have no recursion, so there the depth would need a limit.
    """
    def run(docs: pd.Series) -> pd.Series:
        return docs.map(_redact_document, na_action="ignore")

    return F.pandas_udf(run, "string")(doc)


def summarise_value(v: Column) -> Column:
    """A VARIANT cut for the log: bulky fields become their size, strings are cut at TEXT_CAP, arrays of more than
    ARRAY_CAP elements become their length and a preview, containers below DEPTH_CAP levels a mark."""
    def inner(key: Column, value: Column, depth: int) -> Column:
        kind = F.schema_of_variant(value)
        is_array, text = kind.startswith("ARRAY"), F.try_variant_get(value, "$", "string")
        n = F.size(F.try_variant_get(value, "$", "array<variant>"))
        bulky = (F.when(is_array, F.to_variant_object(F.struct(n.alias("length")))).when(kind == "STRING", F.to_variant_object(F.struct(F.length(text).alias("chars"))))
                 .otherwise(_string(F.lit("[omitted]"))))

        def rebuilt(array: Column, entries: Column) -> Column:
            preview = F.transform(F.slice(entries, 1, PREVIEW), lambda e: e["value"])
            return F.when(array & (n > ARRAY_CAP), F.to_variant_object(F.struct(n.alias("length"), preview.alias("preview")))).otherwise(_container(array, entries))

        nested = _walk(value, lambda k, x: inner(k, x, depth + 1), rebuilt) if depth < DEPTH_CAP else _string(F.lit("[Nested]"))
        return (F.when(key.rlike(BULKY_KEY), bulky).when(kind == "STRING", _string(clamp(text, TEXT_CAP)))
                .when(is_array | kind.startswith("OBJECT"), nested).otherwise(value))

    return inner(F.lit(""), v, 0)


def csv_cell(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def fixed6(name: str) -> Column:
    """A non-negative double column with six decimals, rounded by its exact binary value.

    format_string rounds the shortest decimal form instead, which differs near ties. The value's fraction times a power
    of two is a whole number; rounding it to millionths is exact in decimals. Small values have lower bits, so the power
    grows as they fall; what is under 2^-30 is 0 whatever its bits.
    """
    def rounded(bits: int) -> str:
        scaled = f"CAST(CAST(({name} - floor({name})) * {2.0 ** bits!r}D AS BIGINT) AS DECIMAL(20,0))"
        return f"CAST(({scaled} * 2000000BD + {2 ** bits}BD) div {2 ** (bits + 1)}BD AS BIGINT)"

    millionths = F.expr(f"CASE WHEN {name} < {2.0 ** -20!r}D THEN {rounded(82)} WHEN {name} < {2.0 ** -10!r}D THEN {rounded(72)} ELSE {rounded(62)} END")
    whole = F.floor(F.col(name)).cast("long") + F.when(millionths >= 1_000_000, 1).otherwise(0)
    return F.concat(whole.cast("string"), F.lit("."), F.lpad((millionths % 1_000_000).cast("string"), 6, "0"))


def error_class(raw: Column) -> Column:
    out = F.lit("generic")
    for pattern, kind in reversed(ERROR_RULES):
        out = F.when(raw.rlike(pattern), kind).otherwise(out)
    return out


def fault_title(kind: Column) -> Column:
    k = F.trim(F.coalesce(kind, F.lit("")))
    titles = F.create_map(*[F.lit(x) for pair in FAULT_TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(titles, k), F.lit(OTHER_FAULT_TITLE))


def benign_warning(w: Column) -> Column:
    """The one warning that a journal replay always raises."""
    return F.contains(w, F.lit(REPLAYED_SNAPSHOT)) & F.contains(w, F.lit(REPLAYED_SEQ))


def split_warnings(ws: Column) -> Column:
    said = F.filter(F.coalesce(ws, F.array().cast("array<string>")), lambda w: F.trim(w) != "")
    return F.struct(F.filter(said, benign_warning).alias("benign"), F.filter(said, lambda w: ~benign_warning(w)).alias("serious"))


def logged_command(command: Column, ok: Column) -> Column:
    """Successful polls stay out of the log."""
    return ~(ok & command.isin(*QUIET_COMMANDS))
