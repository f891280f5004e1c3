"""Strict checks on JSON documents held as VARIANT.

A schema read coerces (``"5"`` becomes 5), the rules here reject, so the type of every
field is taken from the document itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE_INTEGER = 9_007_199_254_740_991


def parse(text: Column) -> Column:
    """The document, null where the text is no JSON."""
    return F.try_parse_json(text)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` so that it is computed once per row.

    The optimizer pushes a filter below a projection by repeating the projected
    expression in it; it does not do so through explode. Worth it for costly values that
    many later columns and filters use.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def parse_rows(df: DataFrame, source: str, name: str) -> DataFrame:
    """Adds the parsed document as ``name``."""
    return once(df, name, parse(F.col(source)))


def at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def type_of(doc: Column, path: str = "$") -> Column:
    """BIGINT, STRING, BOOLEAN, ...; null where the field is absent, VOID for a JSON null."""
    return F.schema_of_variant(at(doc, path))


def text(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "string")


def whole(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "bigint")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def is_text(doc: Column, path: str) -> Column:
    return _yes(type_of(doc, path) == "STRING")


def is_object(doc: Column, path: str) -> Column:
    return _yes(type_of(doc, path).startswith("OBJECT"))


def is_array(doc: Column, path: str) -> Column:
    return _yes(type_of(doc, path).startswith("ARRAY"))


def is_number(doc: Column, path: str) -> Column:
    t = type_of(doc, path)
    return _yes((t == "BIGINT") | (t == "DOUBLE") | t.startswith("DECIMAL"))


def is_count(doc: Column, path: str) -> Column:
    """A whole number from 0 that survives a double; 5.0 counts, "5" does not."""
    v = F.try_variant_get(doc, path, "double")
    return is_number(doc, path) & _yes((v >= 0) & (v <= SAFE_INTEGER) & (v == F.floor(v)))


def is_positive(doc: Column, path: str) -> Column:
    return is_count(doc, path) & _yes(F.try_variant_get(doc, path, "double") > 0)


def is_bool(doc: Column, path: str) -> Column:
    return _yes(type_of(doc, path) == "BOOLEAN")


def absent_or(doc: Column, path: str, check: Column) -> Column:
    """Older documents leave fields out; a wrong type is still wrong."""
    return type_of(doc, path).isNull() | check


def elements(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<variant>")
