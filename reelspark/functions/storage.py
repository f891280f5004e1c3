"""Byte rates, disk thresholds and WAV sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed reserves in bytes and audio seconds, and the WAV header layout.
GIB = 1024 * 1024 * 1024
STARTUP_BYTES, STARTUP_SECONDS = 2 * GIB, 7200
CRITICAL_BYTES, CRITICAL_SECONDS = GIB, 1800
WARNING_BYTES, WARNING_SECONDS = 5 * GIB, 14400
HEADER_PCM, HEADER_FLOAT, RF64_EXTRA = 44, 56, 36
RIFF_LIMIT = 4_294_967_295


def bytes_per_second(rate: Column, channels: Column, bit_depth: Column) -> Column:
    """Null where the format is not a recordable one."""
    ok = (rate > 0) & (channels > 0) & bit_depth.isin(16, 24, 32)
    return F.when(ok, (rate * channels * F.floor(bit_depth / 8)).cast("long"))


def _threshold(fixed: int, seconds: int, bps: Column) -> Column:
    return F.greatest(F.lit(fixed).cast("long"), bps * seconds)


def storage_report(available: Column, bps: Column) -> Column:
    critical = _threshold(CRITICAL_BYTES, CRITICAL_SECONDS, bps)
    warning = _threshold(WARNING_BYTES, WARNING_SECONDS, bps)
    startup = _threshold(STARTUP_BYTES, STARTUP_SECONDS, bps)
    return F.struct(
        F.when(available <= critical, "critical").when(available <= warning, "warning").otherwise("healthy").alias("status"),
        (available >= startup).alias("can_start"),
        startup.alias("startup_required_bytes"), warning.alias("warning_threshold_bytes"), critical.alias("critical_threshold_bytes"),
        F.floor(available / bps).cast("long").alias("remaining_recording_seconds"),
        F.floor(F.greatest(F.lit(0).cast("long"), available - critical) / bps).cast("long").alias("safe_recording_seconds"))


def wav_plan(frames: Column, channels: Column, bit_depth: Column) -> Column:
    """Container and file size of a WAV with this many frames; 32 bit is float."""
    header = F.when(bit_depth == 32, HEADER_FLOAT).otherwise(HEADER_PCM).cast("long")
    data = frames * channels * F.floor(bit_depth / 8)
    pad = data % 2
    rf64 = header - 8 + data + pad > RIFF_LIMIT
    size = header + F.when(rf64, RF64_EXTRA).otherwise(0) + data + pad
    return F.struct(F.when(rf64, "rf64").otherwise("riff").alias("container"),
                    data.cast("long").alias("data_bytes"), size.cast("long").alias("file_bytes"))


def required_data_bytes(rate: Column, bit_depth: Column, hours: Column) -> Column:
    ok = rate.isNotNull() & bit_depth.isin(16, 24, 32) & hours.isNotNull()
    return F.when(ok, rate * (bit_depth / 8) * hours * 3600)
