"""Entitlements, machine codes and delivered names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROLLBACK_GRACE_SECONDS = 86_400
DAY = 86_400


def license_reason(now: Column, last_seen: Column, expires: Column, bound_code: Column, machine_code: Column,
                   hashes_match: Column) -> Column:
    """Why an entitlement is refused, null when it is valid; ``expires`` is exclusive."""
    rolled_back = F.coalesce(now + ROLLBACK_GRACE_SECONDS < last_seen, F.lit(False))
    other = machine_code.isNotNull() & (machine_code != "") & ~(
        F.coalesce(bound_code == machine_code, F.lit(False)) | F.coalesce(hashes_match, F.lit(False)))
    return (F.when(rolled_back, "clock_rollback").when(F.coalesce(now >= expires, F.lit(False)), "expired")
            .when(other, "wrong_machine"))


def days_remaining(now: Column, expires: Column) -> Column:
    return F.when(expires.isNotNull(), F.greatest(F.lit(0).cast("long"), F.ceil((expires - now) / DAY).cast("long")))


def fingerprint_matches(stored: Column, current: Column) -> Column:
    """Two hits among three or more stored hashes, otherwise all; repeats count twice."""
    hits = F.size(F.filter(stored, lambda h: F.array_contains(current, h)))
    enough = F.when(F.size(stored) >= 3, hits >= 2).otherwise(hits == F.size(stored))
    return (F.size(stored) > 0) & (F.size(current) > 0) & enough


def normal_machine_code(code: Column) -> Column:
    """Twelve base-32 characters in three groups, null for anything else."""
    compact = F.regexp_replace(F.translate(F.upper(code), "OIL", "011"), "[^0-9A-HJKMNP-TV-Z]", "")
    grouped = F.concat_ws("-", F.substring(compact, 1, 4), F.substring(compact, 5, 4), F.substring(compact, 9, 4))
    return F.when(F.length(compact) == 12, grouped)


def component_digest(hashes: Column) -> Column:
    """SHA-256 over the sorted component hashes, the input of a machine code."""
    return F.sha2(F.array_join(F.array_sort(hashes), ","), 256)


def expiry_seconds(day: Column) -> Column:
    """Exclusive expiry of a ``YYYY-MM-DD`` text: the second after that UTC day; null if it is no date."""
    date = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(day, "yyyy-MM-dd"))
    return (F.datediff(date, F.lit("1970-01-01")).cast("long") + 1) * DAY


def expiry_day(expires: Column) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor((expires - 1) / DAY).cast("int")), "yyyy-MM-dd")


def safe_name(raw: Column) -> Column:
    """A folder name usable on every file system, at most 80 characters."""
    trimmed = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(trimmed, r'[<>:"/\\|?*\x00-\x1F]', "_"), r"[. ]+$", "")
    return F.when(clean == "", "recording").otherwise(F.substring(clean, 1, 80))


def delivered_name(session: Column, stem: Column, stamp: Column, collision: Column, ext: Column) -> Column:
    extra = F.when(collision > 0, F.concat(F.lit("-"), (collision + 1).cast("string"))).otherwise("")
    return F.concat(safe_name(session), F.lit("-"), stem, F.lit("-"), stamp, extra, ext)
