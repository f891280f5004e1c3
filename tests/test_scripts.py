import json
import random
import re

from pyspark.sql import functions as F

from reelspark.sources import scripts


def plain_cells(line, delimiter):
    cells, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if c == '"' and quoted and line[i + 1:i + 2] == '"':
            cell += c
            i += 1
        elif c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            cells.append(cell.strip())
            cell = ""
        else:
            cell += c
        i += 1
    return [*cells, cell.strip()]


def test_cells_equal_a_character_loop(spark):
    r = random.Random(4)
    lines = ["".join(r.choice('ab ,"\t') for _ in range(r.randint(0, 14))) for _ in range(600)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    for d in (",", "\t"):
        got = df.select("line", scripts.cells(F.col("line"), d).alias("c")).collect()
        assert [(x.line, x.c) for x in got] == [(x, plain_cells(x, d)) for x in lines]


def ingest(spark, **files):
    df = spark.createDataFrame(list(files.items()), "script_id string, content string")
    items = sorted((r.script_id, r.line_no, r.item_id, r.text, r.label) for r in scripts.script_items(df).collect())
    errors = sorted((r.script_id, r.line_no or 0, r.code) for r in scripts.script_errors(df).collect())
    return items, errors


def test_script_cases(spark):
    items, errors = ingest(
        spark, tabs="1\thello, world\n2\tbye, now", mixed="id,text\n1\tone\n2\ttwo", quoted='0001,"Hello, world",calm', gap="1,a\n2,b\n3,\n4,d\n1,again",
        plain="﻿first\r\n\r\n second ", blank=" \n\n", headless="label,id\nx,1")
    assert items == [
        ("gap", 1, "1", "a", ""), ("gap", 2, "2", "b", ""), ("gap", 4, "4", "d", ""), ("mixed", 2, "1", "one", ""), ("mixed", 3, "2", "two", ""),
        ("plain", 1, "0001", "first", ""), ("plain", 2, "0002", "second", ""), ("quoted", 1, "0001", "Hello, world", "calm"),
        ("tabs", 1, "1", "hello, world", ""), ("tabs", 2, "2", "bye, now", "")]
    assert errors == [("blank", 0, "empty_file"), ("gap", 3, "empty_text"), ("gap", 5, "duplicate_id"), ("headless", 0, "no_text_column"), ("mixed", 1, "empty_text")]


def test_redaction_and_summary_at_any_depth(spark):
    """Nested secrets never pass; texts that look like arrays stay texts; what is too deep is masked."""
    from reelspark.functions import text as t

    docs = ['{"message":"saved C:\\\\Users\\\\tester\\\\a.wav","attributes":{"token":"S","phase":"recording"}}', '{"a":{"token":"S"},"list":[{"password":"P"},["/tmp/x y"]]}', '"plain /tmp/a"', "[]", "null",
            '{"k":' * 50 + '{"token":{"a":["x"]},"v":["/tmp/a",{"secret":1,"n":1.50}]}' + "}" * 50, None]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = {r.i: r.v for r in df.select("i", t.redact_json(F.to_json(F.parse_json("d"))).alias("v")).collect()}
    assert got[0] == '{"attributes":{"phase":"recording","token":"[Filtered]"},"message":"saved [LocalPath]"}'
    assert got[1] == '{"a":{"token":"[Filtered]"},"list":[{"password":"[Filtered]"},["[LocalPath] y"]]}'
    assert (got[2], got[3], got[4]) == ('"plain [LocalPath]"', "[]", "null") and got[6] is None
    assert got[5] == '{"k":' * 50 + '{"token":"[Filtered]","v":["[LocalPath]",{"n":1.5,"secret":"[Filtered]"}]}' + "}" * 50
    rng = random.Random(1)

    def made(depth):
        kind = rng.randrange(6) if depth else rng.randrange(4)
        if kind < 4:
            return ['a "b" /home/x', 12, None, True][kind]
        return [made(depth - 1) for _ in range(3)] if kind == 4 else {rng.choice(["a", "token", "my_text", "é\\", "/tmp/key"]) + str(i) * (i > 1): made(depth - 1) for i in range(3)}

    def plain(v, key=""):
        if re.search(t.SENSITIVE_KEY, key):
            return t.FILTERED
        if isinstance(v, str):
            return v.replace("/home/x", "[LocalPath]")
        return [plain(x) for x in v] if isinstance(v, list) else {k: plain(x, k) for k, x in v.items()} if isinstance(v, dict) else v

    for _ in range(300):
        v = made(7)
        assert json.loads(t._redact_document(json.dumps(v))) == plain(v)
    docs = ['{"note":"[note] hello","items":[1,2],"text":"abc","content":{"x":1},"many":[' + ",".join(map(str, range(13))) + "]}", '{"a":{"b":{"c":{"d":{"e":1}}}},"s":"' + "x" * 300 + '"}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, d string")
    got = {r.i: r.v for r in df.select("i", F.to_json(t.summarise_value(F.parse_json("d"))).alias("v")).collect()}
    assert got[0] == '{"content":"[omitted]","items":{"length":2},"many":{"length":13,"preview":[0,1,2,3,4,5,6,7]},"note":"[note] hello","text":{"chars":3}}'
    assert got[1] == '{"a":{"b":{"c":{"d":"[Nested]"}}},"s":"' + "x" * 240 + '…[truncated 60]"}'
