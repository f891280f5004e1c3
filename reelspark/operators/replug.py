"""The protocol of a replug run: two starts, the device gone and back between them, the old session refused and sealed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelspark.operators.checks import check_rows
from reelspark.operators.scan import Scan, chunk_of, scan
from reelspark.session import written

C = F.col
KEYS = ["session_id"]


def longest_streak(rows: DataFrame, good, width: int) -> DataFrame:
    """session_id, streak: the longest run of rows in a row that are good; a long session is scanned in chunks."""
    rows = scan(rows.select(*KEYS, "idx", F.coalesce(good, F.lit(False)).alias("good"), chunk_of("idx", width).alias("chunk")), KEYS, ["idx"], "chunk",
                Scan(run={"before": (C("good").cast("long"), ~C("good"), F.lit(False))}))
    return rows.groupBy(*KEYS).agg(F.max(F.when(C("good"), C("before") + 1).otherwise(0)).alias("streak"))


def protocol_facts(calls: DataFrame, width: int) -> DataFrame:
    """One row a session from its requests, each with its response.

    ``calls``: session_id, idx, request_id, command, ok (null without a response); of a start ``pair_ok`` (payload and snapshot are those
    of the run), of device lists ``matches`` and ``absent``, of the old session's commands ``old`` (they name it), of stops the
    snapshot's ``stop_status`` and ``stop_old`` (it is the first session's).
    """
    start = C("command") == "start_session"
    of_start = lambda c: F.when(start, c)
    bounds = calls.groupBy(*KEYS).agg(F.count_if(start).alias("starts"), F.min(of_start(C("idx"))).alias("first"), F.bool_and(of_start(F.coalesce("pair_ok", F.lit(False)))).alias("pairs_ok"),
                                      F.count_distinct(of_start(C("request_id"))).alias("start_ids"))
    second = calls.where(start).join(bounds.select(*KEYS, "first"), KEYS).where(C("idx") > C("first")).groupBy(*KEYS).agg(F.min("idx").alias("second"))
    # Written, as are the facts: otherwise each of their readers repeats all joins before it, and the memory of all of them adds up in its tasks.
    bounds = written(bounds.join(second, KEYS, "left"), "bounds")
    rows = calls.join(bounds.select(*KEYS, "first", "second"), KEYS)
    said, between = F.coalesce("ok", F.lit(False)), (C("idx") > C("first")) & (C("idx") < C("second"))
    lists, gone = C("command") == "list_devices", F.coalesce("absent", F.lit(False))
    first_of = lambda cond: F.min(F.when(cond, C("idx")))
    old = lambda c: between & (C("command") == c)
    stop = (C("command") == "stop_session") & said
    facts = rows.groupBy(*KEYS).agg(
        F.count_if(lists & (C("idx") < C("first")) & said & C("matches")).alias("initial_lists"), first_of(lists & between & said & gone).alias("absent_at"),
        *[F.count_if(old(f"{c}_session") & C("old")).alias(f"old_{c}s") for c in ("export", "resume")],
        *[F.bool_or(old(f"{c}_session") & C("old") & (C("ok") == F.lit(False))).alias(f"{c}_refused") for c in ("export", "resume")],
        *[first_of(old(f"{c}_session")).alias(f"{c}_at") for c in ("export", "resume")],
        F.count_if(stop & between & C("stop_old") & (C("stop_status") == "faulted")).alias("before_stops"),
        F.max(F.when(stop & (C("idx") > C("second")) & ~C("stop_old") & (C("stop_status") == "stopped"), C("idx"))).alias("after_stop"))
    facts = written(bounds.join(facts, KEYS), "facts")
    shut = calls.where((C("command") == "shutdown") & said).join(facts.select(*KEYS, "after_stop"), KEYS).groupBy(*KEYS).agg(F.count_if(C("idx") > C("after_stop")).alias("shutdowns"))
    back = calls.where(lists).join(facts.select(*KEYS, "first", "second", "absent_at"), KEYS).where(between & (C("idx") > C("absent_at")))
    streaks = longest_streak(written(back.select(*KEYS, "idx", "ok", "matches"), "back"), said & C("matches"), width)
    return facts.join(shut, KEYS, "left").join(streaks, KEYS, "left").fillna(0, ["starts", "shutdowns", "streak"])


def replug_protocol_checks(calls: DataFrame, ready: DataFrame, width: int) -> DataFrame:
    """``ready`` (session_id, idx) are the engine's ready events."""
    facts = protocol_facts(calls, width)
    seen = ready.join(facts.select(*KEYS, "first"), KEYS).groupBy(*KEYS).agg(F.count_if(C("idx") < C("first")).alias("ready"))
    facts = facts.join(seen, KEYS, "left")
    refused = lambda c: (C(f"old_{c}s") == 1) & C(f"{c}_refused") & (C(f"{c}_at") < C("absent_at"))
    return check_rows(facts, KEYS, [
        ("replug-protocol-two-starts", (C("starts") == 2) & C("pairs_ok") & (C("start_ids") == 2)),
        ("replug-protocol-transition", (C("initial_lists") >= 1) & C("absent_at").isNotNull() & (C("streak") >= 2) & refused("export") & refused("resume")),
        ("replug-protocol-seals-and-shutdown", (C("ready") >= 1) & (C("before_stops") >= 1) & C("after_stop").isNotNull() & (C("shutdowns") == 1))])
