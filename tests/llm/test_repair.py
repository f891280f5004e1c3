import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from reelspark.llm import catalog, repair

SF = "/root/testdata/sf0.001"
OK = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\f\r"


def damaged(rows):
    """[(conv, turn, role, text)] of one conversation, in order."""
    out = []
    for c, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = re.sub("[.!?]", "", text)
        if k == 4:
            role = "user"
        out += [(turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """All ways with up to two inserted rows at each place (more never help)."""
    bad = faults(rows)
    ways = []
    each = []
    for (_, role, text), f in zip(rows, bad, strict=True):
        own = [("D", 4, None, "")]
        if f not in ("blank", "duplicate"):
            t = 3 * (f == "truncated")
            own += [("K", t, role, text), ("R", 3 + t, "user", text), ("R", 3 + t, "assistant", text)]
        each.append(own)
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for picks in itertools.product(*each):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(p[1] for p in picks) + 3 * sum(map(len, ins))
            lines, audit = [], ""
            for i, more in enumerate(ins):
                lines += [(r, "") for r in more]
                audit += "I" * len(more)
                if i < len(picks):
                    audit += picks[i][0]
                    if picks[i][2] is not None:
                        lines.append((picks[i][2], picks[i][3]))
            if OK.fullmatch("".join(r[:1] or "-" for r, _ in lines)):
                ways.append((cost, audit, "\n".join(f"{r}:{t}" for r, t in lines)))
    return min(ways)


def plain(rows):
    """The same by all strings of each state, without any dropping."""
    states = {"": (0, "", [])}  # role initials so far, cut to what matters -> (cost, audit, lines)

    def go(state, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}.get((state, initial))

    def put(new, state, way):
        if state is not None and (state not in new or way[:2] < new[state][:2]):
            new[state] = way

    def grown(states):
        for _ in range(3):
            new = dict(states)
            for s, (cost, audit, lines) in states.items():
                for role in ("user", "assistant"):
                    put(new, go(s, role[0]), (cost + 3, audit + "I", [*lines, f"{role}:"]))
            states = new
        return states

    for (_, role, text), f in zip(rows, faults(rows), strict=True):
        states, new = grown(states), {}
        t = 3 * (f == "truncated")
        for s, (cost, audit, lines) in states.items():
            put(new, s, (cost + 4, audit + "D", lines))
            if f not in ("blank", "duplicate"):
                put(new, go(s, role[:1]), (cost + t, audit + "K", [*lines, f"{role}:{text}"]))
                for r in ("user", "assistant"):
                    put(new, go(s, r[0]), (cost + 3 + t, audit + "R", [*lines, f"{r}:{text}"]))
        states = new
    ends = [w for s, w in grown(states).items() if s in ("", "a")]
    cost, audit, lines = min(ends, key=lambda w: w[:2])
    return cost, audit, "\n".join(lines)


def streamed(rows):
    c = repair.Conversation(1)
    for (turn, role, text), f in zip(rows, faults(rows), strict=True):
        c.row(turn, role, text, f == "blank", f == "duplicate", f == "truncated")
    told = c.end()
    text = "\n".join(f"{r}:{t}" for _, _, e, r, t in c.out if e != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == told[-1]
    return told[6], told[7], text


def some(rng, n):
    roles = ["system", "user", "assistant", "tool", "", " "]
    return [(i, rng.choice(roles), rng.choice(["a.", "b!", "c", "", " ", "d?\n", f"{i}."])) for i in range(n)]


def test_against_all_edits():
    rng = random.Random(5)
    for _ in range(120):
        rows = some(rng, rng.randrange(4))
        assert streamed(rows) == brute(rows), rows
    for _ in range(1500):
        rows = some(rng, rng.randrange(30))
        assert streamed(rows) == plain(rows), rows


def test_long_conversation_stays_short_in_memory():
    c, most = repair.Conversation(1), 0
    roles = ["user", "user", "assistant", "tool", "assistant", "user", "system"]
    rng = random.Random(3)
    for i in range(20000):
        c.row(i, rng.choice(roles), f"{i}.", False, False, i % 5 == 0)
        c.out.clear()
        most = max(most, max(len(c.repair.edits(n)) for _, n in c.repair.alive.values()))
    assert most < 200 and len(c.audit) > 15000


def wanted(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = damaged([r for r in rows if r[0] == c])
        bad = faults(own)
        cost, audit, text = plain(own)
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[c] = (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in catalog.QUERIES["op13_survivor_viterbi"](spark, SF).collect()} == wanted(rows)


def test_nulls_ties_repeats_extra_columns(spark, tmp_path):
    long = "word " * 200_000 + "."
    rows = [(1, None, "user", "x."), (1, 1, "user", "b."), (1, 1, "assistant", "a."), (1, 1, "user", "b."), (1, 5, None, None), (None, 0, "user", "q."), (None, None, "assistant", "z."),
            (2, 3, "system", long), (2, 4, "", "é!"), (3, None, None, None), *((9, t, "user", "same.") for t in range(40)), *((k, 0, "user", "x") for k in range(100, 160))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"copies": F.lit(7), "k": F.lit(1), "blank": F.lit(True)})
    got = {r[0]: tuple(r)[1:] for r in repair.repaired(repair.damage(df)).collect()}
    assert got == wanted(rows)
    assert any(v == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for v in got.values())
    turns = repair.repaired_turns(repair.damage(df)).where("conv_id = 9").orderBy("at").collect()
    text = "\n".join(f"{r['role']}:{r['text']}" for r in turns if r["edit"] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == got[9][-1] and "".join(r["edit"] for r in turns) == got[9][-2]
    assert repair.repaired(repair.damage(df.where("false"))).collect() == []


@pytest.mark.parametrize("kind", ["string", "int"])
def test_other_id_types(spark, kind):
    df = spark.createDataFrame([(1, 0, "user", "a."), (2, 0, "assistant", "b.")], "conv_id long, turn int, role string, text string").withColumn("conv_id", F.col("conv_id").cast(kind))
    assert repair.repaired(repair.damage(df)).count() == 2
