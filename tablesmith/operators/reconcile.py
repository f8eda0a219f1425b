"""Reconciliation of a source table with a target table."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import comparable
from tablesmith.operators.profiling import check_columns
from tablesmith.session import stage


def row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows on both sides and whether they agree, from one job."""
    tagged = source.select(F.lit(1).alias("s")).unionAll(target.select(F.lit(0).alias("s")))
    counts = tagged.agg(F.count_if(F.col("s") == 1).alias("source_rows"), F.count_if(F.col("s") == 0).alias("target_rows"))
    return counts.withColumn("row_count_match", F.col("source_rows") == F.col("target_rows"))


def schema_match(source: DataFrame, target: DataFrame) -> bool:
    """Equal sets of column names; order and types do not matter."""
    return set(source.columns) == set(target.columns)


def schema_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Columns missing on a side, or differing in type or in allowing nulls."""
    ours = {f.name: f for f in source.schema.fields}
    theirs = {f.name: f for f in target.schema.fields}
    rows = []
    for name in dict.fromkeys([*ours, *theirs]):
        a, b = ours.get(name), theirs.get(name)
        if a is None:
            rows.append((name, "missing_in_source", None, b.dataType.simpleString()))
        elif b is None:
            rows.append((name, "missing_in_target", a.dataType.simpleString(), None))
        elif a.dataType != b.dataType:
            rows.append((name, "type_changed", a.dataType.simpleString(), b.dataType.simpleString()))
        elif a.nullable != b.nullable:
            rows.append((name, "nullability_changed", str(a.nullable).lower(), str(b.nullable).lower()))
    return source.sparkSession.createDataFrame(rows, "column string, issue string, source string, target string")


def _shared(source: DataFrame, target: DataFrame) -> list[str]:
    names = [c for c in source.columns if c in target.columns]
    if not names:
        raise ValueError("the tables share no column")
    return names


def _in_common(source: DataFrame, target: DataFrame, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns in a common type: numbers as the wider one, other changed types as text."""
    left, right = comparable(source.select(*names)), comparable(target.select(*names))
    for name in names:
        a, b = left.schema[name].dataType, right.schema[name].dataType
        if a == b:
            continue
        whole = all(isinstance(t, T.IntegralType) for t in (a, b))
        kind = "bigint" if whole else "double" if all(isinstance(t, T.NumericType) for t in (a, b)) else "string"
        left, right = (side.withColumn(name, F.col(name).cast(kind)) for side in (left, right))
    return left, right


def _grouped(source: DataFrame, target: DataFrame) -> DataFrame:
    """Copies of every distinct row per side, over the shared columns: one exchange."""
    names = _shared(source, target)
    left, right = _in_common(source, target, names)
    both = left.withColumn("_side", F.lit(1)).unionByName(right.withColumn("_side", F.lit(-1)))
    return both.groupBy(*names).agg(
        F.count_if(F.col("_side") > 0).alias("_source"), F.count_if(F.col("_side") < 0).alias("_target")
    )


def row_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Rows whose number of copies differs: positive surplus in the source, negative in the target.

    Columns are matched by name and nulls equal each other; columns of one side only are left to the schema diff and
    the issue list. Columns whose types differ are compared in a common type. Copies collapse before
    the exchange, so a row repeated without end costs one row per task.
    """
    grouped = _grouped(source, target).withColumn("difference", F.col("_source") - F.col("_target"))
    return grouped.where(F.col("difference") != 0).drop("_source", "_target")


def require_unique(df: DataFrame, key: Sequence[str], side: str) -> None:
    repeated = df.groupBy(*key).count().where("count > 1").limit(1).collect()
    if repeated:
        values = {k: repeated[0][k] for k in key}
        raise ValueError(f"the key is not unique in the {side}: {values}")


def keyed_diff(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    tolerance: Mapping[str, float] | None = None,
    check_keys: bool = True,
) -> DataFrame:
    """Missing keys, extra keys and changed cells, one row each.

    ``change`` is ``missing`` (not in the target), ``extra`` (not in the source) or
    ``changed`` with the column and both values as text. ``tolerance`` allows a
    numeric distance per column. A repeated key is refused; null keys equal each other.
    """
    if check_keys:
        require_unique(source, key, "source")
        require_unique(target, key, "target")
    tolerance = dict(tolerance or {})
    names = [c for c in _shared(source, target) if c not in key]
    left, right = _in_common(source, target, [*key, *names])
    left = left.select(*[F.col(k).alias(f"_sk_{k}") for k in key], *[F.col(c).alias(f"_s_{c}") for c in names], F.lit(True).alias("_in_source"))
    right = right.select(*[F.col(k).alias(f"_tk_{k}") for k in key], *[F.col(c).alias(f"_t_{c}") for c in names], F.lit(True).alias("_in_target"))
    same_key = functools.reduce(operator.and_, [F.col(f"_sk_{k}").eqNullSafe(F.col(f"_tk_{k}")) for k in key])
    joined = left.join(right, same_key, "full")
    keys = [F.when(F.col("_in_source").isNull(), F.col(f"_tk_{k}")).otherwise(F.col(f"_sk_{k}")).alias(k) for k in key]
    cells = [
        F.when(
            ~_same(F.col(f"_s_{c}"), F.col(f"_t_{c}"), tolerance.get(c)),
            _change("changed", F.lit(c), F.col(f"_s_{c}").cast("string"), F.col(f"_t_{c}").cast("string")),
        )
        for c in names
    ]
    nothing = F.lit(None).cast("string")
    changes = (
        F.when(F.col("_in_target").isNull(), F.array(_change("missing", nothing, nothing, nothing)))
        .when(F.col("_in_source").isNull(), F.array(_change("extra", nothing, nothing, nothing)))
        .otherwise(F.array_compact(F.array(*cells)) if cells else F.array())
    )
    return joined.select(*keys, F.explode(changes).alias("_c")).select(*key, "_c.*")


#: A tree of digests has so many branches at each of its two levels.
BRANCHES = 1024


def differing_buckets(source: DataFrame, target: DataFrame, key: Sequence[str], branches: int = BRANCHES) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides whose bucket of keys differs, over the shared columns in a common type.

    A bucket is told by its number of rows and two sums of row hashes. The first level has ``branches`` buckets by a hash of the key; only those that differ
    are looked at again, cut into as many each. What travels is a row per bucket and task, so the exchange does not grow with the tables, and each
    list of buckets that is broadcast is bounded by ``branches`` and its square.
    """
    names = _shared(source, target)
    sides = [side.withColumn("_b", F.xxhash64(*[F.col(k).isNull() for k in key], *[F.col(k) for k in key])) for side in _in_common(source, target, names)]
    level = {1: F.pmod(F.col("_b"), F.lit(branches)), 2: F.pmod(F.col("_b"), F.lit(branches * branches))}

    def tasked(side: DataFrame, sign: int, bucket: Column) -> DataFrame:
        values = [F.col("`" + n.replace("`", "``") + "`") for n in names]
        rows = [F.xxhash64(F.lit(seed), *[v.isNull() for v in values], *values).cast("decimal(38,0)") * sign for seed in (1, 2)]
        return side.select(bucket.alias("bucket"), F.lit(sign).alias("n"), rows[0].alias("d1"), rows[1].alias("d2"))

    def differing(left: DataFrame, right: DataFrame, bucket: Column) -> DataFrame:
        sums = tasked(left, 1, bucket).unionByName(tasked(right, -1, bucket)).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
        return stage(sums.where("n <> 0 OR d1 <> 0 OR d2 <> 0").select("bucket"), "buckets")

    for depth in (1, 2):
        found = F.broadcast(differing(*sides, level[depth]).withColumnRenamed("bucket", "_found"))
        sides = [side.join(found, level[depth] == F.col("_found"), "left_semi") for side in sides]
    return sides[0].drop("_b"), sides[1].drop("_b")


def bucket_diff(
    source: DataFrame, target: DataFrame, key: Sequence[str], tolerance: Mapping[str, float] | None = None, branches: int = BRANCHES
) -> DataFrame:
    """As :func:`keyed_diff`, but only rows of buckets that differ are shuffled and compared; for tables that are nearly the same.

    Both sides are scanned three times, by key and digest first. A repeated key is refused only where its bucket differs.
    """
    return keyed_diff(*differing_buckets(source, target, key, branches), key, tolerance)


def _same(a: Column, b: Column, tolerance: float | None) -> Column:
    equal = a.eqNullSafe(b)
    return equal if tolerance is None else equal | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False))


def _change(kind: str, column: Column, source: Column, target: Column) -> Column:
    return F.struct(F.lit(kind).alias("change"), column.alias("column"), source.alias("source"), target.alias("target"))


def key_sample(df: DataFrame, key: Sequence[str], percent: int) -> DataFrame:
    """The rows whose key falls into the sample; both sides of a compare keep the same keys.

    Decided by the first 32 bits of the SHA-256 of the key as text, so the width of a number makes no difference.
    """
    texts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    digest = F.conv(F.substring(F.sha2(F.concat_ws("\u001f", *texts), 256), 1, 8), 16, 10).cast("bigint")
    return df.where(F.pmod(digest, F.lit(100)) < percent)


def issues(source: DataFrame, target: DataFrame) -> DataFrame:
    """Differences with severity: row count, columns, changed types, and rows found on one side only."""
    totals = _grouped(source, target).agg(
        F.coalesce(F.sum("_source"), F.lit(0)).alias("source_rows"),
        F.coalesce(F.sum("_target"), F.lit(0)).alias("target_rows"),
        F.coalesce(F.sum(F.greatest(F.col("_source") - F.col("_target"), F.lit(0))), F.lit(0)).alias("only_source"),
        F.coalesce(F.sum(F.greatest(F.col("_target") - F.col("_source"), F.lit(0))), F.lit(0)).alias("only_target"),
    )
    a, b = ", ".join(sorted(source.columns)), ", ".join(sorted(target.columns))
    tests = [
        ("row_count", F.col("source_rows") != F.col("target_rows"), F.col("source_rows"), F.col("target_rows")),
        ("schema", F.lit(not schema_match(source, target)), F.lit(a), F.lit(b)),
        *[
            ("type", F.lit(True), F.lit(f"{f.name} {f.dataType.simpleString()}"), F.lit(f"{f.name} {target.schema[f.name].dataType.simpleString()}"))
            for f in source.schema.fields
            if f.name in target.columns and f.dataType != target.schema[f.name].dataType
        ],
        ("rows", (F.col("only_source") > 0) | (F.col("only_target") > 0), F.col("only_source"), F.col("only_target")),
    ]
    found = [
        F.when(
            test,
            F.struct(
                F.lit(kind).alias("type"), mine.cast("string").alias("source"), other.cast("string").alias("target"),
                F.lit("HIGH").alias("severity"),
            ),
        )
        for kind, test, mine, other in tests
    ]
    return totals.select(F.explode(F.array_compact(F.array(*found))).alias("_i")).select("_i.*")


def summary(found: DataFrame) -> DataFrame:
    """One row from the issues: do counts and columns match, how many differences are there."""
    return found.agg(
        (F.count_if(F.col("type") == "row_count") == 0).alias("row_count_match"),
        (F.count_if(F.col("type") == "schema") == 0).alias("schema_match"),
        F.count("*").alias("data_discrepancies"),
    )


def quality_issues(
    source: DataFrame,
    target: DataFrame,
    complete: Sequence[str] = (),
    unique: Sequence[str] = (),
    consistent: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The same quality checks on both sides, next to each other."""
    ours = check_columns(source, complete, unique, consistent).withColumnRenamed("share", "source")
    theirs = check_columns(target, complete, unique, consistent).withColumnRenamed("share", "target")
    return ours.join(theirs, ["check", "name"], "full")
