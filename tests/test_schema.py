"""Schema violations against a plain reading of the same schema."""

import copy
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from reelspark.functions.schema import violations
from reelspark.plans.qualification import plan_schema

SCHEMA = plan_schema("p-v1")
TYPES = {"string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
         "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool), "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == int(v)}


def plain(v, s, path, root):
    if s is True:
        return []
    out = []
    if "$ref" in s:
        out += plain(v, root["$defs"][s["$ref"].split("/")[-1]], path, root)
    same = lambda a, b: type(a) is type(b) and a == b or TYPES["number"](a) and TYPES["number"](b) and a == b
    number, text, items = TYPES["number"](v), isinstance(v, str), v if isinstance(v, list) else []
    broken = {"type": lambda x: not TYPES[x](v), "const": lambda x: not same(v, x), "enum": lambda x: not any(same(v, y) for y in x), "pattern": lambda x: text and not re.search(x, v),
              "minLength": lambda x: text and len(v) < x, "maxLength": lambda x: text and len(v) > x, "minimum": lambda x: number and v < x, "maximum": lambda x: number and v > x,
              "minItems": lambda x: isinstance(v, list) and len(v) < x, "maxItems": lambda x: isinstance(v, list) and len(v) > x,
              "uniqueItems": lambda x: x and len({json.dumps(i, sort_keys=True) for i in items}) < len(items)}
    out += [(path, k) for k, f in broken.items() if k in s and f(s[k])]
    for i, x in enumerate(items if "items" in s else []):
        out += plain(x, s["items"], f"{path}/{i}", root)
    if isinstance(v, dict):
        out += [(f"{path}/{k}", "required") for k in s.get("required", []) if k not in v]
        known = s.get("properties", {})
        if s.get("additionalProperties") is False:
            out += [(f"{path}/{k}", "additionalProperties") for k in v if k not in known]
        for k, inner in known.items():
            if k in v:
                out += plain(v[k], inner, f"{path}/{k}", root)
    for part in s.get("allOf", []):
        out += plain(v, part, path, root)
    if "if" in s:
        out += plain(v, s.get("then", True) if not plain(v, s["if"], path, root) else s.get("else", True), path, root)
    return out


def valid():
    run = {"id": "r1", "mode": "short", "min_seconds": 30, "export": True}
    back = {"id": "r2", "mode": "recover", "phase1_evidence_run_id": "r1", "phase1_report": "x", "production_eligible": False}
    target = {k: "x" for k in ("hostname", "windows_release", "device_id", "device_name", "driver_version", "usb_port", "serial")}
    target |= {"platform": "win32", "architecture": "x64", "channels": [1, 2], "primary_format": {"sample_rate": 48000, "bit_depth": 24, "channel": 1}}
    release = {"app_version": "1", "installer_path": "p", "installer_sha256": "a" * 64, "engine_sha256": "B" * 64, "acceptance_tool_sha256": "0" * 64}
    return {"schema_version": 1, "profile": "p-v1", "qualification_id": "q.1", "release": release, "target": target, "required_runs": [run, back]}


def places(v):
    if isinstance(v, dict | list):
        for k in list(v) if isinstance(v, dict) else range(len(v)):
            yield v, k
            yield from places(v[k])


def damaged(rng):
    doc = copy.deepcopy(valid())
    for _ in range(rng.randrange(4)):
        where, k = rng.choice(list(places(doc)))
        do = rng.randrange(4)
        if do == 0:
            del where[k]
        elif do == 1 and isinstance(where, dict):
            where["other"] = 1
        else:
            where[k] = rng.choice([None, "", "recover", "abrupt-enospc", "x y", 0, 1, 2.5, 300, True, [], {}, [1, 1], "z" * 200, 48000.0])
    return doc


def test_equals_plain_reading(spark):
    rng = random.Random(6)
    docs = [valid(), [], "x", None, *(damaged(rng) for _ in range(400))]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(10**6, "{")], "i int, d string")
    got = {r.i: r.v for r in df.select("i", violations(F.try_parse_json("d"), SCHEMA).alias("v")).collect()}
    assert got[0] == [] and got[10**6] is None
    for i, d in enumerate(docs):
        assert sorted(map(tuple, got[i])) == sorted(plain(d, SCHEMA, "", SCHEMA)), d


def test_unknown_keywords_are_refused(spark):
    with pytest.raises(ValueError, match="oneOf"):
        violations(F.col("x"), {"oneOf": []})


def test_a_value_is_read_once_not_once_a_keyword(spark):
    """The expression holds a few reads for each value that the schema names, not for each of its keywords."""
    df = spark.createDataFrame([("{}",)], "d string").select(violations(F.try_parse_json("d"), SCHEMA).alias("v"))
    text = df._jdf.queryExecution().analyzed().toString()
    assert text.count("schema_of_variant") <= 50 and text.count("try_variant_get") <= 250
