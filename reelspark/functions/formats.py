"""Sample formats of devices and deliveries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Best capture format first.
PREFERRED = ("i24", "f32", "i32", "i16")


def normal_format(fmt: Column) -> Column:
    f = F.lower(F.trim(fmt))
    return F.when(f.isin(*PREFERRED), f)


def precision_bits(fmt: Column) -> Column:
    f = F.lower(F.trim(fmt))
    return (F.when(f.rlike("^[iu](8|16|24|32|64)$"), F.regexp_extract(f, "([0-9]+)", 1).cast("int"))
            .when(f == "f32", 24).when(f == "f64", 53)).cast("int")


def minimum_bits(delivery_depth: Column) -> Column:
    return F.when(delivery_depth == 16, 16).when(delivery_depth.isin(24, 32), 24)


def delivery_depth(fmt: Column) -> Column:
    f = normal_format(fmt)
    return F.when(f == "i16", 16).when(f == "i24", 24).otherwise(32)


def format_of_depth(depth: Column) -> Column:
    return F.when(depth == 16, "i16").when(depth == 32, "f32").otherwise("i24")


def format_rank(fmt: Column) -> Column:
    """0 is best; null for a format that cannot be captured."""
    f = normal_format(fmt)
    rank = F.when(f == PREFERRED[0], 0)
    for i, name in enumerate(PREFERRED[1:], start=1):
        rank = rank.when(f == name, i)
    return rank
