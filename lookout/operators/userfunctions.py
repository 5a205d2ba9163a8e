"""User-written Python functions over columns, batches and groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def map_column(fn: Callable[[pd.Series], pd.Series], kind: T.DataType, column: str) -> Column:
    """A function of a whole Series on a column."""

    @F.pandas_udf(kind)
    def mapped(values: pd.Series) -> pd.Series:
        return fn(values)

    return mapped(F.col(column))


def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """A function of a DataFrame on every Arrow batch, wherever its rows lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def group_partials(
    df: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame], dict[str, float]],
    sums: Sequence[str],
) -> DataFrame:
    """A per-subject function given as sums over parts of the subject's rows.

    ``fn`` sees the rows of one subject in one Arrow batch and returns a number for each of
    ``sums``; Spark adds them up. A subject with very many rows is never in one place.
    """
    keys = list(keys)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *[T.StructField(s, T.DoubleType()) for s in sums]])

    def partial(batch: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, part in batch.groupby(keys, sort=False):
            rows.append((*key, *[float(fn_value) for fn_value in _in_order(fn(part), sums)]))
        return pd.DataFrame(rows, columns=[*keys, *sums])

    return map_batches(df, partial, schema).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def _in_order(values: dict[str, float], names: Sequence[str]) -> list[float]:
    return [values[n] for n in names]
