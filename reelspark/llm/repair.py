"""Conversation structure repair by a Viterbi pass whose survivors coalesce.

A repaired conversation has roles whose initials read `(s?(ua)+)?`. Rows come in order of their turn (nulls first,
ties by role, then text) and are kept, given another role or deleted; empty rows may be inserted anywhere. The
cheapest edits win, of equally cheap ones those whose initials come first in ASCII order.

The pass keeps one survivor for each of the four states of that pattern. Survivors share a tree of backpointers with
reference counts: once all of them descend from one node, the edits up to it are final, leave the tree and go to the
result and the running digest. A survivor that a better one could imitate at less cost is dropped, so the
tree stays short. Ties are decided on the complete edits since the last final one. That is enough: edits of the same
rows at the same cost never are a prefix of one another, since whatever the longer one had more would be insertions.

Rows are read as a stream sorted by conversation, so a conversation of any length takes the memory of its unresolved
edits (and of its result, one letter an edit). What a row alone or a set of equal rows can tell (faults, earlier
copies) is found by Spark before. The digest of a conversation is one chain over its text, hence one task's work.

Nulls count as one space; rows without a conv_id are one conversation. A conversation that loses all its rows has
zeros, no edits and the digest of the empty string. Rows that repeat are duplicates of the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANKS = " \t\n\x0b\f\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing yet, after system, after user, after assistant. The first and the last may end a conversation.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a conversation in the first state may cost more than in the second without ever being better.
AHEAD = {(ASSISTANT, START): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3, (USER, ASSISTANT): 3, (USER, START): 7, (USER, SYSTEM): 3,
         (SYSTEM, ASSISTANT): 6, (SYSTEM, USER): 3, (SYSTEM, START): 6, (START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): 3}
# Columns of the results; conv_id keeps its type.
TURNS = (("conv_id", ""), ("at", "long"), ("edit", "string"), ("role", "string"), ("text", "string"))
COUNTS = (("conv_id", ""), *((c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", "string"), ("repaired_sha256", "string"))
ROLE = {USER: "user", ASSISTANT: "assistant"}
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}


def damage(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copies (0 for a row that is dropped, 2 for one that is repeated) of every row."""
    id_, at = F.col(f"`{key}`"), F.col(f"`{turn}`").cast("long")
    k = F.crc32(F.concat(F.coalesce(id_.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(at.cast("string"), F.lit(" ")))) % 20
    rows = conv.select(id_.alias("conv_id"), at.alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" ")).alias("text"), k.alias("k"))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("k").isin(0, 1), "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"))


def told(rows: DataFrame) -> DataFrame:
    """Adds blank, duplicate (a row of the conversation has its role and text earlier) and truncated."""
    earlier = Window.partitionBy("conv_id", F.col("copies") == 0, "role", F.md5("text")).orderBy(F.col("turn").asc_nulls_first())
    end: Column = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    return rows.repartition("conv_id").select(
        "*", (~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).alias("blank"), (F.row_number().over(earlier) > 1).alias("duplicate"), (~end.isin(".", "!", "?")).alias("truncated"))


class Node:
    __slots__ = ("parent", "edit", "role", "text", "refs")

    def __init__(self, parent: Node | None, edit: str, role: str, text: str):
        self.parent, self.edit, self.role, self.text, self.refs = parent, edit, role, text, 0
        if parent is not None:
            parent.refs += 1


class Repair:
    """Edits of one conversation; `final(edit, role, text)` is told each once it is certain."""

    def __init__(self, final: Callable[[str, str, str], None]):
        self.final = final
        self.root = Node(None, "", "", "")
        self.alive: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.root.refs += 1

    def edits(self, node: Node) -> str:
        out = []
        while node is not self.root:
            out.append(node.edit)
            node = node.parent
        return "".join(reversed(out))

    def best(self, choices: list[tuple[int, Node, str, str, str]]) -> tuple[int, Node, str, str, str]:
        """The cheapest of (cost, earlier node, edit, role, text), ties by all unresolved edits."""
        least = min(c[0] for c in choices)
        tied = [c for c in choices if c[0] == least]
        return tied[0] if len(tied) == 1 else min(tied, key=lambda c: self.edits(c[1]) + c[2])

    def take(self, choices: dict[int, list[tuple[int, Node, str, str, str]]]) -> None:
        """The best choice of each state survives."""
        found = {s: self.best(c) for s, c in choices.items() if c}
        found = {s: c for s, c in found.items() if not any(found[o][0] + AHEAD[o, s] < c[0] for o in found if o != s)}
        before = self.alive
        self.alive = {}
        for s, (cost, node, edit, role, text) in found.items():
            new = Node(node, edit, role, text) if edit else node
            new.refs += 1
            self.alive[s] = cost, new
        for _, node in before.values():
            self.free(node)

    def free(self, node: Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node is not self.root:
            node = node.parent
            node.refs -= 1

    def insert(self) -> None:
        """Room for inserted rows before the next row or the end."""
        stay = {s: [(cost, node, "", "", "")] for s, (cost, node) in self.alive.items()}
        user = stay.get(USER, []) + [(cost + INSERT, node, "I", ROLE[USER], "") for s, (cost, node) in self.alive.items() if s != USER]
        self.take(stay | {USER: user})
        if USER in self.alive:
            cost, node = self.alive[USER]
            stay = {s: [(c, n, "", "", "")] for s, (c, n) in self.alive.items()}
            self.take(stay | {ASSISTANT: stay.get(ASSISTANT, []) + [(cost + INSERT, node, "I", ROLE[ASSISTANT], "")]})

    def row(self, role: str, text: str, forced: bool, truncated: bool) -> None:
        self.insert()
        choices: dict[int, list] = {s: [(cost + DELETE, node, "D", "", "")] for s, (cost, node) in self.alive.items()}
        if not forced:
            more, keep = TRUNCATED * truncated, NEXT.get(role[:1], {})
            for s, (cost, node) in self.alive.items():
                if s in keep:
                    choices.setdefault(keep[s], []).append((cost + more, node, "K", role, text))
                else:
                    to = ASSISTANT if s == USER else USER
                    choices.setdefault(to, []).append((cost + REROLE + more, node, "R", ROLE[to], text))
                if keep.get(s) == SYSTEM:  # a first system row may become the user's as well
                    choices.setdefault(USER, []).append((cost + REROLE + more, node, "R", ROLE[USER], text))
        self.take(choices)
        self.settle()

    def settle(self) -> None:
        """Tells the edits that all survivors share."""
        if self.root.refs > 1:
            return
        node, chain = next(iter(self.alive.values()))[1], []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            if self.root.refs > 1:
                break
            self.final(node.edit, node.role, node.text)
            node.parent = None
            self.root = node

    def end(self) -> int:
        """Tells what is left; the cost of all edits."""
        self.insert()
        cost, node, *_ = self.best([(*self.alive[s], "", "", "") for s in (START, ASSISTANT) if s in self.alive])
        chain = []
        while node is not self.root:
            chain.append(node)
            node = node.parent
        for node in reversed(chain):
            self.final(node.edit, node.role, node.text)
        return cost


class Conversation:
    """Counts and edits of one conversation from its rows in order."""

    def __init__(self, key):
        self.key, self.lines, self.audit = key, 0, []
        self.gaps = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.turn = None
        self.turns, self.before = 0, None
        self.digest = hashlib.sha256()
        self.out: list[tuple] = []
        self.repair = Repair(self.final)

    def final(self, edit: str, role: str, text: str) -> None:
        self.out.append((self.key, len(self.audit), edit, None if edit == "D" else role, None if edit == "D" else text))
        self.audit.append(edit)
        if edit != "D":
            self.digest.update(f"{chr(10) * (self.lines > 0)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.lines += 1

    def row(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if blank:
            self.blank += 1
        elif duplicate:
            self.duplicate += 1
        elif truncated:
            self.truncated += 1
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = role[:1]
        self.repair.row(role, text, blank or duplicate, truncated)

    def end(self) -> tuple:
        cost = self.repair.end()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.digest.hexdigest()


def walk(rows: DataFrame, turns: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams sorted rows; gives the edits (`turns`) or a row for each conversation."""
    from pyspark.sql.pandas.types import to_arrow_type

    key = to_arrow_type(rows.schema["conv_id"].dataType)
    kinds = (key, pa.int64(), pa.string(), pa.string(), pa.string()) if turns else (key, *[pa.int64()] * 6, pa.string(), pa.string())
    names = [n for n, _ in (TURNS if turns else COUNTS)]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Conversation | None = None
        for batch in batches:
            out: list[tuple] = []
            for at in range(0, len(batch), 1024):  # so that only few texts are Python strings at a time
                for key, turn, role, text, copies, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if now is None or now.key != key:
                        if now is not None:
                            told = now.end()
                            out += now.out if turns else [told]
                        now = Conversation(key)
                    for copy in range(copies):
                        now.row(turn, role, text, blank, duplicate or copy > 0, truncated)
                    if turns:
                        out += now.out
                    now.out.clear()
                if out:
                    yield packed(out)
                    out = []
        if now is not None:
            told = now.end()
            yield packed(now.out if turns else [told])

    return run


def _sorted(rows: DataFrame) -> DataFrame:
    rows = told(rows).select("conv_id", "turn", "role", "text", "copies", "blank", "duplicate", "truncated")
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")


def _schema(rows: DataFrame, fields: tuple) -> str:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ", ".join(f"{n} {t or kind}" for n, t in fields)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, at, edit, role, text: every edit in order, with what it leaves (nulls for a deletion).

    `rows` has conv_id, turn, role, text and copies, as `damage` gives them (copies 1: as it stands).
    """
    return _sorted(rows).mapInArrow(walk(rows, True), _schema(rows, TURNS))


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, counts of faults, illegal, cost, audit and repaired_sha256 of every conversation of `rows`."""
    return _sorted(rows).mapInArrow(walk(rows, False), _schema(rows, COUNTS))
