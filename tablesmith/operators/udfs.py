"""User functions in pandas, shaped so that no group is ever gathered whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.operators.relational import merge


def apply_values(
    df: DataFrame, column: str, function: Callable, dtype: str, name: str, **parameters
) -> DataFrame:
    """``function(series, **parameters)`` on batches of one column."""

    def batch(values):
        return function(values, **parameters)

    return df.withColumn(name, _series_udf(batch, dtype)(F.col(column)))


def apply_rows(df: DataFrame, columns: Sequence[str], function: Callable, dtype: str, name: str) -> DataFrame:
    """``function(frame)`` on batches of several columns, giving one value per row."""

    def batch(frame):
        return function(frame)

    batch.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
    return df.withColumn(name, F.pandas_udf(batch, dtype)(F.struct(*columns)))


def transform_groups(
    df: DataFrame,
    by: Sequence[str],
    statistics: Mapping[str, Column],
    function: Callable[[pd.DataFrame], pd.Series],
    columns: Sequence[str],
    dtype: str,
    name: str,
) -> DataFrame:
    """A value per row from the row and statistics of its group.

    The statistics are ordinary aggregates, combined before the exchange and joined
    back, so a group of any size stays spread over its tasks.
    """
    stats = df.groupBy(*by).agg(*[c.alias(n) for n, c in statistics.items()])
    joined = merge(df, stats, list(by), how="left", null_equal=True)
    return apply_rows(joined, [*columns, *statistics], function, dtype, name).select(*df.columns, name)


def aggregate_groups(
    df: DataFrame,
    by: Sequence[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    partial_schema: str,
    merge: Mapping[str, Column],
) -> DataFrame:
    """A user aggregate in two steps.

    ``partial`` turns a batch into a few rows per group, wherever the rows are; the
    columns of ``merge`` combine those rows. ``partial_schema`` names the partial
    columns after the group columns.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield partial(frame)

    fields = [f for f in df.schema.fields if f.name in by]
    schema = T.StructType(fields + T.StructType.fromDDL(partial_schema).fields)
    small = df.mapInPandas(batches, schema)
    return small.groupBy(*by).agg(*[c.alias(n) for n, c in merge.items()])


def _series_udf(batch: Callable, dtype: str):
    batch.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, dtype)
