"""Helpers that several operators share: Arrow mapping with pass-through columns, shared tables, docs columns."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from reelspark.session import written

__all__ = ["boxed", "kept_schema", "map_rows", "pieces", "prepared", "release", "texts_of", "unboxed", "written"]


def prepared(df: DataFrame, text: str, key: str) -> DataFrame:
    """`df` with the two columns an operator needs, cast to string and long."""
    return df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def boxed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and text as in `prepared`, and all other columns in a struct, where no name can clash."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.struct(*others).alias("row"))


def unboxed(df: DataFrame, like: DataFrame, text: str = "text") -> DataFrame:
    """The columns of `like` from a boxed table, the text as it now is."""
    return df.select(*(F.col("text").cast(f.dataType).alias(f.name) if f.name == text else F.col(f"row.`{f.name}`").alias(f.name) for f in like.schema.fields))


def kept_schema(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    """Columns of `df`, then `fields`; a result replaces an input column of its name."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name.lower() not in new] + fields)


def release() -> None:
    """Gives back what a finished task has freed: its worker stays, beside those of the tasks to come."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, the empty one for a null."""
    return ["" if t is None else t for t in column.to_pylist()]


def pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most about `most` bytes of text each (a longer text gets a range of its own)."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if len(texts) > start:
        yield start, len(texts)


def map_rows(df: DataFrame, text: str, fields: list[T.StructField], make: Callable[[], Callable[[list[str]], dict[str, list]]], most: int = 4 << 20) -> DataFrame:
    """Adds `fields` to every row of `df`, computed from its text column.

    `make()` runs once a task and returns the function from a list of texts (null read as empty) to
    one list per field. Rows are handed over in pieces of about `most` bytes, so memory stays bounded.
    """
    schema = kept_schema(df, fields)
    kept = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]
    at = df.columns.index(text)
    places = [df.columns.index(k) for k in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for i, j in pieces(batch.column(at), most):
                part = batch.slice(i, j - i)
                out = fn(texts_of(part.column(at)))
                arrays = [part.column(p) for p in places] + [pa.array(out[n], type=k) for n, k in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(n for n, _ in kinds)])
        del fn
        release()

    return df.mapInArrow(run, schema)
