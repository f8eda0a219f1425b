"""Profiles of a table: counts, types, distributions, outliers and quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.functions.columns import comparable, missing_as_null, round_even, row_digest
from tablesmith.operators.rules import Rule, flag_rows

#: Quantile sketches err by one part in so many; ranges around a wanted place reach so many times as far, which leaves room for a place more or less.
ACCURACY, REACH = 10_000, 4


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def profile_columns(df: DataFrame, approximate: bool = False, by_digest: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, values present, nulls, share of nulls, distinct values.

    One scan for any number of columns: each row becomes its values by position, equal ones collapse in each task
    before they are shuffled. Columns of long texts may be counted ``by_digest``: SHA-256 instead of the text travels.
    NaN counts as null.
    """
    df = missing_as_null(comparable(df))
    fields = df.schema.fields
    # a value at place -1 in each row counts the rows
    every = F.struct(F.lit(-1).alias("position"), F.lit("").alias("value"))
    values = [F.struct(F.lit(i).alias("position"), _as_text(f, by_digest).alias("value")) for i, f in enumerate(fields)]
    long = df.select(F.explode(F.array(every, *values)).alias("_v")).select("_v.*").where("value IS NOT NULL")
    if approximate:
        counted = long.groupBy("position").agg(F.count("*").alias("non_null"), F.approx_count_distinct("value").alias("unique"))
    else:
        distinct = long.groupBy("position", "value").agg(F.count("*").alias("n"))
        counted = distinct.groupBy("position").agg(F.sum("n").alias("non_null"), F.count("*").alias("unique"))
    found = counted.agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct("non_null", "unique")))).alias("_m"))  # a value per column
    rows = F.coalesce(F.try_element_at("_m", F.lit(-1))["non_null"], F.lit(0))
    profiles = []
    for i, field in enumerate(fields):
        mine = F.try_element_at("_m", F.lit(i))
        present = F.coalesce(mine["non_null"], F.lit(0))
        profiles.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(field.name).alias("column"),
                F.lit(field.dataType.simpleString()).alias("dtype"),
                present.alias("non_null"),
                (rows - present).alias("null_count"),
                F.coalesce(mine["unique"], F.lit(0)).alias("unique"),
                rows.alias("row_count"),
            )
        )
    percent = round_even(F.try_divide(F.col("null_count") * 100, F.col("row_count")))
    return found.select(F.explode(F.array(*profiles)).alias("_p")).select("_p.*").withColumn("null_percent", percent)


def _as_text(field: T.StructField, by_digest: Sequence[str]) -> Column:
    """A text that is equal for equal values of the column only."""
    value, kind = F.col(_quoted(field.name)), field.dataType
    if isinstance(kind, (T.StructType, T.ArrayType)):
        return F.when(value.isNotNull(), F.to_json(value, {"ignoreNullFields": "false"}))
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(value == 0, F.lit("0.0")).otherwise(value.cast("string"))  # either zero
    return F.sha2(value, 256) if field.name in by_digest else value.cast("string")


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None, by_digest: bool = False) -> DataFrame:
    """Rows beyond the first of each equal group; nulls equal each other.

    ``by_digest`` sends SHA-256 digests through the exchange instead of the values,
    which pays off for long texts.
    """
    columns = list(subset or df.columns)
    if by_digest:
        grouped = df.select(row_digest(columns).alias("_d")).groupBy("_d").count()
    else:
        grouped = comparable(df.select(*columns)).groupBy(*columns).count()
    return grouped.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("count") > 1).alias("duplicated_groups"),
    )


def profile_table(df: DataFrame, by_digest: bool = False) -> DataFrame:
    return duplicate_rows(df, by_digest=by_digest).select(
        "total_rows", F.lit(len(df.columns)).cast("bigint").alias("total_columns"), "duplicate_rows"
    )


def quality_flags(df: DataFrame, by_digest: bool = False) -> DataFrame:
    """The flags a profile raises; none for a clean table."""
    rules = [Rule("Duplicate rows detected", "MEDIUM", F.col("duplicate_rows") > 0)]
    return flag_rows(profile_table(df, by_digest), rules, ["duplicate_rows"]).drop("detail")


def profile_document(df: DataFrame) -> DataFrame:
    """Column profiles together with the totals of the table."""
    total = F.lit(len(df.columns)).cast("bigint")
    return profile_columns(df).select(
        "row_count", total.alias("column_count"), "position", "column", "dtype",
        "non_null", "null_count", "null_percent", "unique",
    )


def write_profile(df: DataFrame, path: str, name: str, by_digest: bool = False) -> None:
    """Write the profile and its flags as JSON datasets below ``path``."""
    document = profile_document(df).select(F.lit(name).alias("file"), F.current_timestamp().alias("discovered_at"), "*")
    document.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/schema")
    quality_flags(df, by_digest).write.mode("overwrite").json(f"{path}/flags")


def long_form(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as rows of ``column, value``; NaN is null."""
    doubles = missing_as_null(df.select(*[F.col(_quoted(c)).cast("double").alias(c) for c in columns]))
    return doubles.unpivot([], list(columns), "column", "value")


def _bounds(df: DataFrame, columns: Sequence[str], shares: Sequence[float], *measures: Column) -> Row:
    """One row from one scan: ``n0, n1, ...`` values present, ``a0, a1, ...`` approximate quantiles around each share, and the measures."""
    around = [min(1.0, max(0.0, share + side * REACH / ACCURACY)) for share in shares for side in (-1, 1)]
    values = [F.col(_quoted(c)).cast("double") for c in columns]
    counts = [F.count(v).alias(f"n{i}") for i, v in enumerate(values)]
    near = [F.percentile_approx(v, [0.0, *around, 1.0], ACCURACY).alias(f"a{i}") for i, v in enumerate(values)]
    return df.agg(*counts, *near, *measures).first()


def _regions(row: Row, at: int) -> list[list[float]]:
    """Ranges of values, apart from each other, that hold the wanted places of a column."""
    near = row[f"a{at}"]
    if not near:
        return []
    if row[f"n{at}"] <= ACCURACY:  # one place more or less is more than the reach
        return [[near[0], near[-1]]]
    regions: list[list[float]] = []
    for low, high in sorted(zip(near[1:-1:2], near[2:-1:2])):
        if regions and low <= regions[-1][1]:
            regions[-1][1] = max(high, regions[-1][1])
        else:
            regions.append([low, high])
    return regions


def _quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], row: Row) -> DataFrame:
    entries = []
    for i, name in enumerate(columns):
        value, region = F.col(_quoted(name)).cast("double"), F.when(F.lit(False), F.lit(0))
        ranges = _regions(row, i)
        for j, (low, high) in enumerate(ranges):
            region = region.when(value < low, 2 * j).when(value <= high, 2 * j + 1)
        region = F.when(value.isNotNull(), region.otherwise(2 * len(ranges)))
        entries.append(F.struct(F.lit(i).alias("position"), region.alias("region"), F.when(region % 2 == 1, value).alias("value")))
    long = df.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*").where("region IS NOT NULL")
    counts = long.groupBy("position", "region", "value").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("position").orderBy("region")
    sizes = counts.groupBy("position", "region").agg(F.sum("n").alias("n")).select(
        F.col("position").alias("_position"),
        F.col("region").alias("_region"),
        (F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
        F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    # At most two regions per column and share, and one more: the broadcast is bounded by the arguments.
    same = (F.col("position") == F.col("_position")) & (F.col("region") == F.col("_region"))
    inside = Window.partitionBy("position", "region").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    kept = counts.where("value IS NOT NULL").join(F.broadcast(sizes), same)
    placed = kept.withColumn("upto", F.col("before") + F.sum("n").over(inside))
    places = [(F.col("total") - 1) * share for share in shares]
    picks = []
    for i, index in enumerate(side(place) for place in places for side in (F.floor, F.ceil)):
        here = (index < F.col("upto")) & (index >= F.col("upto") - F.col("n"))
        picks.append(F.max(F.when(here, F.col("value"))).alias(f"v{i}"))
    found = placed.groupBy("position").agg(F.max("total").alias("total"), *picks)
    names = F.array(*[F.lit(c) for c in columns])
    results = []
    for i, place in enumerate(places):
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        results.append((low + (high - low) * (place - F.floor(place))).alias(f"q{i}"))
    return found.select(F.get(names, F.col("position")).alias("column"), *results)


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per column, ``q0, q1, ...``; NaN is left out like null.

    The built-in exact percentile gathers all distinct values in one buffer. Here a first scan finds approximate
    quantiles a little below and above each share, whose error is proven, and a second one counts what lies
    outside these ranges and sorts only the values inside: less than a thousandth of the rows for each share.
    """
    df = missing_as_null(df)
    return _quantiles(df, columns, shares, _bounds(df, columns, shares))


def describe(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, standard deviation, minimum, quantiles and maximum per column; NaN is left out like null. Two scans."""
    df = missing_as_null(df)
    measures = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    values = [F.col(_quoted(c)).cast("double") for c in columns]
    row = _bounds(df, columns, shares, *[f(v).alias(f"{m}{i}") for m, f in measures.items() for i, v in enumerate(values)])
    rows = [(c, row[f"n{i}"], *[row[f"{m}{i}"] for m in measures]) for i, c in enumerate(columns)]
    shape = "column string, count bigint, mean double, std double, min double, max double"
    return df.sparkSession.createDataFrame(rows, shape).join(_quantiles(df, columns, shares, row), "column", "left")


def outliers(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values beyond ``reach`` interquartile ranges from the quartiles, counted per column."""
    width = (F.col("q1") - F.col("q0")) * reach
    bounds = quantiles(df, columns, (0.25, 0.75)).select(
        F.col("column").alias("_column"), (F.col("q0") - width).alias("low"), (F.col("q1") + width).alias("high")
    )
    # One row per profiled column: the number of columns bounds the broadcast.
    return (
        long_form(df, columns)
        .join(F.broadcast(bounds), F.col("column") == F.col("_column"))
        .groupBy("column")
        .agg(
            F.max("low").alias("low"),
            F.max("high").alias("high"),
            F.count_if(F.col("value") < F.col("low")).alias("below"),
            F.count_if(F.col("value") > F.col("high")).alias("above"),
        )
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """The ``k`` most frequent values per column with their share of the values present, and the share of values that differ.

    Ties go to the smaller text.
    """
    frames = []
    for name in columns:
        text = F.col(_quoted(name)).cast("string")
        counts = df.groupBy(text.alias("value")).agg(F.count("*").alias("n")).where("value IS NOT NULL")
        totals = counts.agg(F.sum("n").alias("present"), F.count("*").alias("different"))
        best = counts.orderBy(F.col("n").desc(), F.col("value")).limit(k)
        frames.append(
            best.select(
                F.lit(name).alias("column"), "value", "n",
                (F.col("n") / totals.select("present").scalar()).alias("share"),
                (totals.select("different").scalar() / totals.select("present").scalar()).alias("cardinality_ratio"),
            )
        )
    return _union(frames)


def value_patterns(df: DataFrame, column: str) -> DataFrame:
    """Shapes of a text column: letters as A, digits as 9, with their counts."""
    shape = F.regexp_replace(F.regexp_replace(F.col(column), "[A-Za-z]", "A"), "[0-9]", "9")
    return df.groupBy(shape.alias("pattern")).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, key: Sequence[str], rows: int) -> DataFrame:
    """A repeatable sample: the rows whose key has the lowest SHA-256 as text, marked as a sample.

    Each task keeps its lowest rows, and those are merged; there is no full sort.
    """
    place = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(_quoted(k)).cast("string"), F.lit("")) for k in key]), 256)
    result = df.orderBy(place, *key).limit(rows)
    return result.withColumn("is_sample", F.lit(rows) < df.agg(F.count("*").alias("n")).select("n").scalar())


def check_columns(
    df: DataFrame,
    complete: Sequence[str] = (),
    unique: Sequence[str] = (),
    consistent: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Shares between 0 and 1 per check: values present, distinct values, rows obeying a rule."""
    consistent = dict(consistent or {})
    frames = []
    rows = F.count(F.lit(1))
    if complete or consistent:
        names = [("completeness", c) for c in complete] + [("consistency", c) for c in consistent]
        shares = [F.try_divide(F.count(c), rows) for c in complete]
        shares += [F.try_divide(F.count_if(rule), rows) for rule in consistent.values()]
        frames.append(_checks(df.agg(*[s.alias(f"s{i}") for i, s in enumerate(shares)]), names))
    for column in unique:
        present = df.where(F.col(column).isNotNull())
        key = F.sha2(column, 256) if df.schema[column].dataType.typeName() == "string" else F.col(column)
        groups = present.groupBy(key.alias("_k")).count()
        share = F.try_divide(F.count("*"), F.sum("count"))
        frames.append(_checks(groups.agg(share.alias("s0")), [("uniqueness", column)]))
    return _union(frames)


def _checks(row: DataFrame, names: Sequence[tuple[str, str]]) -> DataFrame:
    entries = [
        F.struct(F.lit(kind).alias("check"), F.lit(name).alias("name"), F.col(f"s{i}").alias("share"))
        for i, (kind, name) in enumerate(names)
    ]
    return row.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def orphan_keys(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values of the child that the parent lacks, with their row counts.

    Counting before the join leaves one row per key, whatever a hot key holds.
    """
    keys = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).alias(key)).distinct()
    return keys.join(known, key, "left_anti")
