"""Registered queries: every operator bound to the given tables, with its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

_MODULES = ("sessions", "scalars", "telemetry", "gates", "timeline", "scripts", "text", "devices", "fleet", "delivery", "streams")



def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    for module in _MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return dict(_QUERIES), dict(_ORACLES)
