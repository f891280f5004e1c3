"""Paths as text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(path: Column) -> Column:
    """The names on the way to an absolute path, with ``.``, ``..`` and repeated separators resolved; null for a relative one."""
    def walk(done: Column, step: Column) -> Column:
        back = F.slice(done, 1, F.greatest(F.lit(0), F.size(done) - 1))
        return F.when(step.isin("", "."), done).when(step == "..", back).otherwise(F.array_append(done, step))

    names = F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), walk)
    return F.when(path.startswith("/") | path.rlike(r"^[A-Za-z]:[\\/]"), names)


def folder(path: Column) -> Column:
    """The path without its last name."""
    return F.regexp_replace(path, r"[\\/][^\\/]*$", "")


def within(root: Column, path: Column) -> Column:
    """Is the path the root or below it, by whole names? Links have to be resolved before."""
    top, own = steps(root), steps(path)
    return F.coalesce(F.slice(own, 1, F.size(top)) == top, F.lit(False))
