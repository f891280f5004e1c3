"""Sample counts, durations and the silence marks of a take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0).cast("long")


def _at_least_zero(x: Column) -> Column:
    return F.greatest(_zero(), F.coalesce(x, _zero()))


def half_up(x: Column) -> Column:
    """Rounds .5 towards positive infinity; F.round goes away from zero instead."""
    return F.floor(x + F.lit(0.5)).cast("long")


def samples_to_ms(n: Column, rate: Column) -> Column:
    return F.when(n > 0, half_up(n / F.greatest(rate, F.lit(1)) * 1000)).otherwise(_zero())


def discontinuity_ms(silence: Column, rate: Column) -> Column:
    return half_up(silence / F.greatest(F.lit(1), rate) * 1000)


def format_ms(ms: Column) -> Column:
    return F.concat(F.greatest(_zero(), half_up(ms)).cast("string"), F.lit(" ms"))


def format_wait_seconds(ms: Column) -> Column:
    return F.format_string("%.1f s", (F.greatest(_zero(), ms) / F.lit(1000)).cast("double"))


def format_duration(n: Column, rate: Column) -> Column:
    s = F.greatest(_zero(), F.floor(n / F.greatest(rate, F.lit(1))).cast("long"))
    hours = F.floor(s / 3600).cast("string")
    return F.concat_ws(
        ":", F.when(F.length(hours) < 2, F.lpad(hours, 2, "0")).otherwise(hours),
        F.lpad(F.floor(s % 3600 / 60).cast("string"), 2, "0"), F.lpad((s % 60).cast("string"), 2, "0"))


def head_pad_start(armed: Column, passed: Column, required: Column) -> Column:
    """Start of the qualifying head silence, not of the recording command."""
    armed, passed, required = map(_at_least_zero, (armed, passed, required))
    qualifies = (passed > 0) & (required > 0) & (passed >= required)
    return F.when(qualifies, F.greatest(armed, passed - required)).otherwise(armed)


def head_start(detector: Column, start: Column, recording_started: Column, passed: Column, required: Column) -> Column:
    by_pad = head_pad_start(F.coalesce(F.when(recording_started != 0, recording_started), start), passed, required)
    return F.when(detector == "vad", _at_least_zero(start)).otherwise(by_pad)


def head_silence_ms(start: Column, content_started: Column, rate: Column) -> Column:
    gap = F.greatest(_zero(), content_started - F.greatest(_zero(), start))
    return F.when(content_started > 0, samples_to_ms(gap, rate))


def pad_status(measured_ms: Column, required_ms: Column) -> Column:
    return (F.when(measured_ms.isNull() | (required_ms <= 0), "unknown")
            .when(measured_ms < required_ms, "short").otherwise("met"))


def is_short(measured_ms: Column, required_ms: Column) -> Column:
    return F.coalesce((required_ms > 0) & (measured_ms < required_ms), F.lit(False))


def padded_start(started: Column, first_speech: Column, pad: Column) -> Column:
    started, first_speech, pad = map(_at_least_zero, (started, first_speech, pad))
    return F.when(first_speech <= 0, started).otherwise(F.greatest(started, first_speech - pad))


def padded_end(boundary: Column, last_speech: Column, pad: Column, start: Column) -> Column:
    boundary, last_speech, pad, start = map(_at_least_zero, (boundary, last_speech, pad, start))
    return F.when(last_speech <= 0, boundary).otherwise(
        F.greatest(start + 1, F.least(boundary, last_speech + pad)))


def take_start(detector: Column, enforce: Column, started: Column, passed: Column, content: Column, pad: Column) -> Column:
    by_gate = F.when(enforce & (passed > 0), passed).otherwise(started)
    return F.when(detector == "vad", padded_start(started, content, pad)).otherwise(by_gate)


def take_end(detector: Column, captured: Column, last_speech: Column, pad: Column, start: Column) -> Column:
    """Predicted end of a live take; null while the end still follows the cursor."""
    end = padded_end(captured, last_speech, pad, start)
    return F.when((detector == "vad") & (end < captured), end)


def speech_bounds(started: Column, boundary: Column, first: Column, last: Column, pad: Column) -> Column:
    """(start, end) of a take trimmed to its speech plus padding."""
    f = F.greatest(first, started)
    l = F.least(F.greatest(last, f), boundary)
    s = F.greatest(F.greatest(_zero(), f - pad), started)
    e = F.greatest(F.least(l + pad, boundary), s + 1)
    raw = (first == 0) | (boundary <= started)
    return F.struct(F.when(raw, started).otherwise(s).alias("start"), F.when(raw, boundary).otherwise(e).alias("end"))


def usable_take(status: Column, start: Column, end: Column) -> Column:
    return ~status.isin("interrupted", "needs_rerecord") & (end > start)
