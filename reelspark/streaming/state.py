"""Live rules on Spark's keyed state.

A rule goes through the rows of a key in the order of ``seq`` and keeps a few values between them; Spark holds these
in its state store, checkpoints them and restores them after a restart. The rows of one key and one micro-batch are
one task's: the source's ``files_per_batch`` bounds them. Rows that arrive after a later batch are taken as they come.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PACK = 1 << 18  # rows that a task holds at once to pack them by key


class Rule:
    """Subclasses name their state and output columns (DDL) and say what a row does."""

    state: str
    out: str

    def start(self) -> list:
        return [None] * (self.state.count(",") + 1)

    def row(self, s: list, r: Row) -> tuple | None:
        """Changes the state ``s`` by a row; an output row or none."""

    def after(self, s: list) -> tuple | None:
        """An output row of the key once its rows of a batch are done."""


class _Each(StatefulProcessor):
    def __init__(self, rule: Rule, names: list[str]):
        self.rule, self.made = rule, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("rule", self.rule.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = list(self.value.get() or self.rule.start())  # every call to the state is a trip to the JVM
        for r in sorted(rows, key=lambda r: r["seq"]):
            if (out := self.rule.row(s, r)) is not None:
                yield self.made(*key, *out)
        if (out := self.rule.after(s)) is not None:
            yield self.made(*key, *out)
        self.value.update(tuple(s))

    def close(self) -> None:
        pass


class _Several(_Each):
    """The states of keys that differ in their last column alone, in one value; rows come and go packed."""

    def __init__(self, rule: Rule, key: T.StructField, names: list[str]):
        self.rule, self.last, self.names, self.made = rule, key.name, names, Row("rows")
        one = T.StructType([T.StructField("of", key.dataType), *T._parse_datatype_string(rule.state).fields])
        self.kind = T.StructType([T.StructField("states", T.ArrayType(one))])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("rule", self.kind)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = self.value.get()
        states = {of: s for of, *s in stored[0]} if stored else {}
        rows = [dict(zip(self.names, r, strict=True)) for p in rows for r in zip(*(p[n] for n in self.names), strict=True)]
        met, out = {}, []
        for r in sorted(rows, key=lambda r: r["seq"]):
            of = r[self.last]
            if (s := states.get(of)) is None:
                s = states[of] = list(self.rule.start())
            met[of] = s
            if (made := self.rule.row(s, r)) is not None:
                out.append((*key[:-1], of, *made))
        for of, s in met.items():
            if (made := self.rule.after(s)) is not None:
                out.append((*key[:-1], of, *made))
        if out:
            yield self.made(out)
        self.value.update(([(of, *s) for of, s in states.items()],))


def packed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and an array of each other column; a key has a row for so many of its rows as are met together."""
    others = [c for c in rows.columns if c not in keys]
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in others])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(b.num_rows for b in held) >= PACK):
                lists = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(c, "list") for c in others])
                yield from lists.select([*keys, *(f"{c}_list" for c in others)]).rename_columns([*keys, *others]).to_batches()
                held = []

    return rows.repartition(*keys).mapInArrow(pack, schema)


def follow_rule(rows: DataFrame, keys: list[str], rule: Rule, together: int = 1) -> DataFrame:
    """The keys and the rule's output for a stream of rows with ``seq``.

    Each key of a batch costs trips to the JVM and an Arrow batch, each row a Python object a cell. Where keys are many
    and have few rows, the last one is a running number of which so many values that follow each other go ``together``:
    one state value holds theirs, one task has their rows of a batch, which reach it packed.
    """
    schema = T.StructType([rows.schema[k] for k in keys] + T._parse_datatype_string(rule.out).fields)
    if together == 1:
        return rows.groupBy(*keys).transformWithState(_Each(rule, schema.names), schema, "Append", "None")
    group = [*keys[:-1], "_together"]
    packs = packed(rows.withColumn("_together", F.floor(F.col(keys[-1]) / together)), group)
    each = _Several(rule, rows.schema[keys[-1]], [c for c in rows.columns if c not in group])
    out = packs.groupBy(*group).transformWithState(each, T.StructType([T.StructField("rows", T.ArrayType(schema))]), "Append", "None")
    return out.select(F.inline("rows"))


class LatestOnly(Rule):
    """One value of a receiver is in flight; of those behind it only the newest waits, and follows the acknowledgement.

    Rows are of ``kind`` value, ack (with ``ack_id``) or fault. A fault passes at once, without a delivery number,
    and removes what waits; acknowledgements of another delivery than the one in flight do nothing.
    """

    state = "next long, in_flight long, waiting long"
    out = "seq long, delivery long"

    def start(self):
        return [1, None, None]

    def send(self, s, seq):
        s[0], s[1], s[2] = s[0] + 1, s[0], None
        return seq, s[1]

    def row(self, s, r):
        if r["kind"] == "fault":
            s[2] = None
            return r["seq"], None
        if r["kind"] == "value":
            if s[1] is None:
                return self.send(s, r["seq"])
            s[2] = r["seq"]
        elif s[1] is not None and r["ack_id"] == s[1]:
            s[1] = None
            if s[2] is not None:
                return self.send(s, s[2])
        return None


class HeadSilence(Rule):
    """Phase of a take's head-silence gate after each batch."""

    state = "seq long, armed long, required long, enforce boolean, quiet long, pen long, first long, last long"
    out = "seq long, phase string, passed_sample long, content_started_sample long, last_signal_sample long"

    def row(self, s, r):
        _, _, _, _, quiet, pen, first, last = s
        frames, speech, end, quiet = r["block_end"] - r["block_start"], r["is_speech"], r["block_end"], quiet or 0
        live = end > r["armed"]
        if live:
            quiet = 0 if speech else quiet + frames
            if pen is None and ((0 if speech else quiet) if r["enforce"] else end - r["armed"]) >= r["required"]:
                pen = end
            if speech and (not r["enforce"] or pen is not None and end > pen):
                first = max(r["block_start"], r["armed"], 1) if first is None else first
                last = end
        s[:] = [r["seq"], r["armed"], r["required"], r["enforce"], quiet, pen, first, last]

    def after(self, s):
        seq, armed, required, enforce, _, pen, first, last = s
        phase = "waiting_for_head_silence" if pen is None else "ready_for_speech" if first is None else "speech_started"
        return seq, phase, 0 if pen is None else pen if enforce else armed + required, first or 0, last or 0


class LatePackets(Rule):
    """Places packets on the timeline; the furthest end so far is the watermark."""

    state = "furthest long"
    out = "seq long, verdict string"

    def __init__(self, bin_samples: int = 64):
        self.bin_samples = bin_samples

    def row(self, s, r):
        end, before = r["end_sample"], s[0]
        start = end - r["n_bins"] * self.bin_samples
        if r["n_bins"] <= 0 or start < 0:
            return r["seq"], "drop"
        s[0] = end if before is None else max(before, end)
        if before is None or start == before:
            return r["seq"], "append" if before is None or end > before else "drop"
        return r["seq"], "drop" if end <= before else "reset" if start > before else "trim"


class Discontinuities(Rule):
    """Silence of each streak of discontinuities; it is shown from ``min_ms`` on."""

    state = "count long, silence long, last long, total long"
    out = "seq long, streak_silence_samples long, show boolean"

    def __init__(self, rate: int, streak_ms: int = 50, min_ms: int = 10):
        self.rate, self.streak_ms, self.min_ms = max(1, rate), streak_ms, min_ms

    def row(self, s, r):
        count, silence, last, total = s
        now, new = r["now_ms"], r["count"]
        s[0], s[1] = new, r["silence_samples"]
        if count is None or new == count:
            return None
        if new < count:
            s[3] = 0
        if not (new > count and new > 0):
            return None
        added = max(0, r["silence_samples"] - silence)
        near = last is not None and last > 0 and now - last <= self.streak_ms
        s[2], s[3] = now, added + (total or 0 if near else 0)
        return r["seq"], s[3], int(s[3] / self.rate * 1000 + 0.5) >= self.min_ms


class FaultLatch(Rule):
    """The first fault of a session sticks until a later row clears it."""

    state = "seq long, fault long"
    out = "seq long, fault_seq long"

    def row(self, s, r):
        s[0] = r["seq"]
        if r["cleared"]:
            s[1] = None
        elif r["fault"] and s[1] is None:
            s[1] = r["seq"]

    def after(self, s):
        return tuple(s)


class Generations(Rule):
    """Blocks of a generation older than the newest one seen are dropped."""

    state = "newest long"
    out = "seq long, generation long, reset boolean"

    def row(self, s, r):
        newest, own = s[0], r["generation"]
        if newest is not None and own < newest:
            return None
        s[0] = own
        return r["seq"], own, newest is not None and own > newest


class DigitalSilence(Rule):
    """Running length of exact zeros, suspected from ``limit`` samples on."""

    state = "zeros long"
    out = "seq long, digital_silence_samples long, suspected boolean"

    def __init__(self, limit: int):
        self.limit = limit

    def row(self, s, r):
        s[0] = (s[0] or 0) + r["block_end"] - r["block_start"] if r["peak"] == 0 else 0
        return r["seq"], s[0], s[0] >= self.limit


class _Answers(StatefulProcessor):
    """Open requests of an id by number; a timer of event time closes those without a response."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms, self.made = timeout_ms, Row("request_id", "seq", "response_seq", "timed_out")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "seq long", "at_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [r for r in rows if r["kind"] in ("request", "response")]
        if not rows:
            return
        # Every call to the state is a trip to the JVM, so it is read once and only what a batch leaves open is written.
        stored = {seq: at for (seq,), (at,) in self.open.iterator()}
        open_at = dict(stored)
        for r in sorted(rows, key=lambda r: (r["at_ms"], r["seq"])):
            if r["kind"] == "request":
                open_at[r["seq"]] = r["at_ms"]
            else:
                for seq in [seq for seq, at in open_at.items() if at < r["at_ms"] <= at + self.timeout_ms]:
                    del open_at[seq]
                    yield self.made(*key, seq, r["seq"], False)
        for seq in stored.keys() - open_at.keys():
            self.open.removeKey((seq,))
        for seq, at in open_at.items():
            if stored.get(seq) != at:
                self.open.updateValue((seq,), (at,))
                self.handle.registerTimer(at + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        for (seq,), (at,) in list(self.open.iterator()):
            if at + self.timeout_ms <= expiredTimerInfo.getExpiryTimeInMs():
                self.open.removeKey((seq,))
                yield self.made(*key, seq, None, True)

    def close(self) -> None:
        pass


def answers(rows: DataFrame, timeout_ms: int, late: str) -> DataFrame:
    """request_id, seq, response_seq, timed_out: once for each request, at its first response or when its time is over.

    ``rows`` is one stream of requests, responses and ticks: request_id, kind, seq, at (event time) and at_ms. Whatever
    arrives moves the clock; a response within the time answers all requests of its id that are open.
    """
    schema = T.StructType([rows.schema["request_id"], *T._parse_datatype_string("seq long, response_seq long, timed_out boolean").fields])
    return rows.withWatermark("at", late).groupBy("request_id").transformWithState(_Answers(timeout_ms), schema, "Append", "EventTime")
