"""Does a report belong to the release, host and device of its plan, and does its evidence lie below the reports' root?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelspark.functions import paths
from reelspark.operators.devices import REQUIRED_RATES

C = F.col
# Modes by what a report of theirs has to show, and the files beside it.
ENGINE_MODES = ("inventory", "short", "soak", "unplug", "disk-full", "power-cut", "recover", "default-switch", "replug", "abrupt-enospc")
CAPTURE_MODES = ("short", "soak", "unplug", "disk-full", "power-cut", "default-switch", "replug", "abrupt-enospc")
COMPANIONS = {"telemetry.jsonl": ("inventory", "recover", "inspect"), "protocol.jsonl": ("inspect",), "engine-stderr.log": ("inspect",)}  # modes without the file
MAY_BE_EMPTY = "engine-stderr.log"


def sha256(x: Column) -> Column:
    """A SHA-256 in lower case, null where the text is none."""
    return F.when(x.rlike("^[0-9a-fA-F]{64}$"), F.lower(x))


def _same(a: Column, b: Column) -> Column:
    return sha256(a).eqNullSafe(sha256(b))


def _rules(root: str) -> list[tuple[str, Column, Column]]:
    """(id, condition, where it applies)."""
    r, p, q, mode, always = (lambda c: C(f"report.{c}")), (lambda c: C(f"plan.{c}")), (lambda c: C(f"requirement.{c}")), C("requirement.mode"), F.lit(True)
    host = F.lit(True)
    for c in ("platform", "architecture", "hostname", "windows_release"):
        host = host & r(f"host.{c}").eqNullSafe(p(c))
    target = F.filter(r("devices"), lambda d: d["id"] == p("device_id"))
    offered = F.get(target, 0)["configurations"]
    covered = F.lit(True)
    for rate in REQUIRED_RATES:
        fits = lambda x, ch, rate=rate: (x["min_rate"] <= rate) & (x["max_rate"] >= rate) & (x["channels"] >= ch)
        covered = covered & F.forall(p("channels"), _some(offered, fits))
    phase1 = (r("phase1.qualification_id") == p("qualification_id")) & (r("phase1.run_id") == q("phase1_run_id")) & _same(r("phase1.installer_sha256"), p("installer_sha256"))
    session = paths.within(F.lit(root), r("session_dir")) & r("session_dir_exists")
    out = [
        ("report-schema", r("schema_version") == 1, always), ("qualification-installer", _same(r("installer_sha256"), p("installer_sha256")), always),
        ("acceptance-tool-hash", _same(r("tool_sha256"), p("tool_sha256")), always), ("engine-hash", _same(r("engine_sha256"), p("engine_sha256")), mode.isin(*ENGINE_MODES)), ("host-identity", host, always),
        ("inventory-target-device", F.size(target) == 1, mode == "inventory"), ("inventory-required-configurations", covered, mode == "inventory"),
        ("device-identity", (F.size(r("device_ids")) > 0) & F.forall(r("device_ids"), lambda x: x == p("device_id")), mode != "inventory"),
        ("full-track-container", (r("container") == q("container")) & r("exact_header"), q("container").isNotNull()),
        ("production-eligible", r("production_eligible"), q("production_eligible")), ("phase1-qualification-binding", phase1, mode == "recover"),
        ("report-directory-contained", paths.within(F.lit(root), paths.folder(r("path"))), always), ("recording-evidence-contained", session, mode.isin(*CAPTURE_MODES, "recover", "inspect"))]
    for name, without in COMPANIONS.items():
        there = _some(r("files"), lambda f, _, name=name: (f["name"] == name) & f["regular"] & (F.lit(name == MAY_BE_EMPTY) | (f["size"] > 0)))
        out.append((f"evidence-{name}", there(F.lit(0)), ~mode.isin(*without)))
    return out


def _some(values: Column, fits):
    return lambda x: F.coalesce(F.exists(values, lambda v: fits(v, x)), F.lit(False))


def report_evidence_checks(rows: DataFrame, keys: list[str], root: str) -> DataFrame:
    """keys, check_id, status of every rule that applies to a report.

    ``rows``: the keys and three structs: ``requirement`` (mode, container, production_eligible, phase1_run_id), ``plan`` (release
    hashes, host, device, channels) and ``report`` (what it says, its path, the files beside it, its session's folder).
    """
    said = [F.when(F.coalesce(applies, F.lit(False)), F.struct(F.lit(name).alias("check_id"), F.when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL").alias("status"))) for name, ok, applies in _rules(root)]
    return rows.select(*keys, F.inline(F.array_compact(F.array(*said))))
