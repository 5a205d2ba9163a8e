"""What the operators share: input columns, Arrow stages and sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.session import settled, table  # noqa: F401


def input_columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing columns cannot interfere."""
    return df.select(*(F.col(f"`{name}`").alias(own) for own, name in wanted.items()))


def row_key(doc_id: str = "doc_id", text: str = "text", missing: int = (1 << 63) - 1) -> dict[str, Column]:
    """What tells rows apart: the id (``missing`` in place of null) and a hash of the text. Rows with the same key are one row repeated."""
    return {"doc": F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(missing)), "row": F.xxhash64(F.col(f"`{text}`"))}


def without_rows(docs: DataFrame, keys: dict[str, Column], gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys are in ``gone``, and with one row only of each key in ``repeated``.

    ``keys`` are never null. Only rows of repeated keys are brought together, combined where they are read.
    """
    names = {key: f"_{key}_{k}" for k, key in enumerate(keys)}
    while set(names.values()) & set(docs.columns):
        names = {key: f"_{name}" for key, name in names.items()}
    own = list(names.values())
    marked = docs.withColumns({names[key]: value for key, value in keys.items()})
    gone, repeated = (df.select(*(F.col(key).alias(name) for key, name in names.items())) for df in (gone, repeated))
    left = marked.join(gone, own, "left_anti")
    if repeated.take(1):
        once = left.join(repeated, own, "left_semi").dropDuplicates(own)
        left = left.join(repeated, own, "left_anti").unionByName(once)
    return left.drop(*own)


def schema(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)


def in_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], out: str) -> DataFrame:
    """``work`` over the Arrow batches of each partition; ``out`` is the schema of its batches."""
    return df.mapInArrow(work, out)


def fields(out: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema(out))
