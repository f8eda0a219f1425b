"""Joins, grouping, pivots and cleaning with data-frame habits spelled out for Spark."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, GroupedData, Window
from pyspark.sql import functions as F

from tablesmith.operators.splits import Splits, hot_keys, salt, shuffle_partitions


def group_by(df: DataFrame, *keys: str, dropna: bool = True) -> GroupedData:
    """Group rows; rows with a null key are left out unless ``dropna`` is false."""
    return (df.dropna(subset=list(keys)) if dropna else df).groupBy(*keys)


def merge(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | None = None,
    how: str = "inner",
    left_on: str | None = None,
    right_on: str | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_equal: bool = False,
    spread_hot: str | None = None,
) -> DataFrame:
    """Join on equal names, or on ``left_on``/``right_on`` keeping both columns.

    Clashing other names get the suffixes. ``null_equal`` lets null keys match.
    Adaptive execution splits skewed partitions of inner and left joins by itself, without a look at the data
    beforehand. Where that is off, ``spread_hot`` names the side, ``left`` or ``right``, whose keys may repeat without
    bound: its keys are counted and sampled when the join is declared, rows of keys that fill a
    task get a salt, and the other side repeats only its rows with such a key.
    """
    keys = [on] if isinstance(on, str) else list(on or [])
    if not keys and (left_on is None or right_on is None):
        raise ValueError("name the key columns")
    if spread_hot and how not in ("inner", "left"):
        raise ValueError("hot keys are spread for inner and left joins")
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in shared})
    left_keys = keys or [left_on + suffixes[0] if left_on in shared else left_on]
    right_keys = keys or [right_on + suffixes[1] if right_on in shared else right_on]
    # The right side under names of its own; null keys that cannot match are not sent.
    mine = dict(zip(right_keys, [f"_r{i}" for i in range(len(right_keys))]))
    there = right.withColumns({n: F.col(k) for k, n in mine.items()}).drop(*keys)
    if how in ("inner", "left") and not null_equal:
        there = there.dropna(subset=list(mine.values()))
    pairs = list(zip(left_keys, mine.values()))
    hot = None
    if spread_hot:
        hot = hot_keys(left, left_keys) if spread_hot == "left" else hot_keys(there, list(mine.values()))
    if not hot:
        joined = left.join(there, _equal(pairs, null_equal), how)
        if keys and how in ("outer", "full", "right"):
            joined = joined.withColumns({k: F.coalesce(F.col(k), F.col(mine[k])) for k in keys})
    elif spread_hot == "left":
        joined = _salted_join(left, there, pairs, hot, null_equal, how)
    else:
        swapped = [(n, k) for k, n in pairs]
        joined = _salted_join(there, left, swapped, hot, null_equal, "inner")
        if how == "left":
            known = there.select(*mine.values()).distinct()
            alone = left.join(known, _equal(pairs, null_equal), "left_anti")
            joined = joined.unionByName(alone, allowMissingColumns=True)
    new = [c for c in right.columns if c not in keys]
    return joined.select(*[F.col(_quoted(c)) for c in [*keys, *[c for c in left.columns if c not in keys], *new]])


def _equal(pairs: Sequence[tuple[str, str]], null_equal: bool) -> list[Column]:
    return [F.col(a).eqNullSafe(F.col(b)) if null_equal else F.col(a) == F.col(b) for a, b in pairs]


def _salted_join(
    many: DataFrame, few: DataFrame, pairs: Sequence[tuple[str, str]], hot: Splits, null_equal: bool, how: str
) -> DataFrame:
    """Join a side with hot keys to one without: salt the first, repeat hot rows of the second."""
    same_keys = Splits(tuple(b for _, b in pairs), (), hot.types, hot.points)
    every = F.sequence(F.lit(0), F.lit(shuffle_partitions(many) - 1))
    salted = many.withColumn("_salt", F.when(hot.in_split_group(), salt(many).cast("int")).otherwise(F.lit(0)))
    repeated = few.withColumn(
        "_copy", F.explode(F.when(same_keys.in_split_group(), every).otherwise(F.array(F.lit(0))))
    )
    return salted.join(repeated, [*_equal(pairs, null_equal), F.col("_salt") == F.col("_copy")], how)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def concat(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; a column missing somewhere is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in the given order.

    Spark thins each input partition to one row per key before the exchange, so a
    hot key sends one row per task.
    """
    window = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(window)).where("_place = 1").drop("_place")


def sort_values(df: DataFrame, by: Sequence[str], ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sort with nulls last in both directions."""
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    return df.orderBy(
        *[F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in zip(by, flags)]
    )


def head(df: DataFrame, by: Sequence[str], rows: int, ascending: bool | Sequence[bool] = True) -> DataFrame:
    return sort_values(df, by, ascending).limit(rows)


def fill_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nulls by the mean of the column, read through one scalar subquery each."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return df.withColumns({c: F.coalesce(F.col(c), means.select(c).scalar()) for c in columns})


def replace_values(df: DataFrame, column: str, values: Mapping) -> DataFrame:
    """Swap whole values; others stay."""
    return df.replace(dict(values), subset=[column])


def pivot_table(
    df: DataFrame,
    index: Sequence[str],
    columns: str,
    values: Sequence,
    aggregates: Mapping[str, Column],
    fill_value=None,
) -> DataFrame:
    """Spread ``columns`` over the listed values, one column per value and aggregate.

    Listing the values saves the job that would look for them and keeps the schema
    fixed. Null keys are left out. With one aggregate the columns are named after the
    values, with more ``value_aggregate``.
    """
    rows = df.dropna(subset=[*index, columns])
    named = [a.alias(name) for name, a in aggregates.items()]
    wide = rows.groupBy(*index).pivot(columns, list(values)).agg(*named)
    if fill_value is not None:
        new = [c for c in wide.columns if c not in index]
        wide = wide.fillna(fill_value, subset=new)
    return wide


def distinct_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """The values of a column to pivot on; more than ``limit`` is an error, not a cut."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values; too many columns")
    return sorted(row[0] for row in found)
