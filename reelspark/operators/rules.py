"""Row rules of history, recovery and the workspace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = F.col


def _unfinished() -> Column:
    return (C("pending_items") + C("review_items")) > 0


def session_kind() -> Column:
    running = C("status").isin("recording", "stopping")
    return (F.when(C("history_issue") | (C("status") == "faulted") | (C("overflow_samples") > 0), "attention")
            .when(C("is_active") & (C("status") == "stopping"), "attention")
            .when(C("is_active"), "unfinished").when(running, "attention")
            .when(_unfinished(), "unfinished").otherwise("completed"))


def history_filter(name: str) -> Column:
    if name == "all":
        return F.lit(True)
    return session_kind() == "completed" if name == "completed" else session_kind() != "completed"


def data_health() -> Column:
    broken = C("fault_marker") | C("status").isin("faulted", "recording", "stopping") | (C("overflow_samples") > 0)
    return F.when(broken, "needs_repair").otherwise("normal")


def recovery_plan() -> Column:
    """(can_resume, can_seal, primary, secondary)."""
    def plan(resume, seal, primary, secondary):
        return F.struct(F.lit(resume).alias("can_resume"), F.lit(seal).alias("can_seal"),
                        F.lit(primary).cast("string").alias("primary"), F.lit(secondary).cast("string").alias("secondary"))

    damaged = (C("status") == "faulted") | (C("overflow_samples") > 0)
    running = C("status").isin("recording", "stopping")
    return (F.when(C("is_active"), plan(False, False, None, None))
            .when(damaged, plan(False, True, "seal", None))
            .when(running & _unfinished(), plan(True, True, "resume", "seal"))
            .when(running, plan(False, True, "seal", None))
            .when((C("status") == "stopped") & _unfinished(), plan(True, False, "resume", None))
            .otherwise(plan(False, False, None, None)))


def task_entry() -> Column:
    """(entry, disabled_reason, view_primary)."""
    def entry(kind, reason=None, view=None):
        return F.struct(F.lit(kind).alias("entry"), F.lit(reason).cast("string").alias("disabled_reason"),
                        (F.lit(None) if view is None else view).cast("boolean").alias("view_primary"))

    return (F.when(C("is_active") & (C("status") == "stopping"), entry("continue-stop")).when(C("is_active"), entry("return"))
            .when(C("history_issue"), entry("view-only", "issue")).when(C("readonly"), entry("view-only", "readonly"))
            .when(recovery_plan()["can_seal"], entry("view-only", "fault"))
            .otherwise(entry("view-record", None, ~_unfinished())))


def capture_fault_kind() -> Column:
    capture = (C("status") == "faulted") | (C("overflow_samples") > 0) | (C("storage_status") == "critical")
    return F.when(C("is_active"), F.when(capture, "capture").when(C("engine_status") == "connecting", "engine_recovering")
                  .when(C("engine_status") == "offline", "engine_offline"))


def noise_gate(passed: Column, checking: Column, enabled: Column) -> Column:
    return (F.when(~enabled, "ready").when(checking, "checking").when(passed.isNull(), "pending")
            .when(passed, "ready").otherwise("failed"))
