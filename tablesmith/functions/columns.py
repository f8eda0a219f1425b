"""Column expressions shared by operators and queries."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities from worst to mildest.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def exact(column: str | Column, scale: int = 2) -> Column:
    """The value as a decimal, so that sums do not depend on the order of addition."""
    column = F.col(column) if isinstance(column, str) else column
    return column.cast(f"decimal(18,{scale})")


def exact_sum(column: str | Column, scale: int = 2) -> Column:
    return F.sum(exact(column, scale)).cast("double")


def exact_mean(column: str | Column, scale: int = 2) -> Column:
    """Exact sum over count; null for an empty group."""
    return F.try_divide(exact_sum(column, scale), F.count(column))


def round_even(column: str | Column, places: int = 2) -> Column:
    """Round half to even on the decimal value (2.5 to 2, 0.125 to 0.12)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.bround(column.cast(f"decimal(28,{places + 6})"), places).cast("double")


def is_in(column: str | Column, values: Iterable) -> Column:
    """Membership test that says false, not null, for a null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.isin(list(values)), F.lit(False))


def cut(column: str | Column, bins: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin ``(low, high]`` holding the value; null outside all bins."""
    if len(bins) != len(labels) + 1:
        raise ValueError("one label per bin is needed")
    column = F.col(column) if isinstance(column, str) else column
    inside = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(bins, bins[1:], labels))):
        inside = F.when((column > low) & (column <= high), label).otherwise(inside)
    return inside


def categorical(column: str | Column, categories: Iterable[str]) -> Column:
    """Null for every value outside the allowed categories."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.isin(list(categories)), column)


def clamp(column: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(column, F.lit(high)), F.lit(low))


def tidy(column: str | Column, missing: str = "unknown") -> Column:
    """Trimmed, lower case, blanks as underscores; ``missing`` for a null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.replace(F.lower(F.trim(column)), F.lit(" "), F.lit("_")), F.lit(missing))


def split_parts(column: str | Column, separator: str, parts: int) -> list[Column]:
    """The first parts of a text split at a literal separator, null where missing."""
    column = F.col(column) if isinstance(column, str) else column
    pieces = F.split(column, "\\Q" + separator + "\\E")
    return [F.get(pieces, F.lit(i)) for i in range(parts)]


def null_tokens(column: str | Column, tokens: Iterable[str]) -> Column:
    """Null where the text is one of the tokens."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(~F.coalesce(column.isin(list(tokens)), F.lit(False)), column)


def cast_or(column: str | Column, dtype: str, default) -> Column:
    """Lenient cast: the default where the text does not parse or is null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.try_cast(dtype), F.lit(default).cast(dtype))


def truthy(column: str | Column) -> Column:
    """Text as boolean in the sense of "not empty"."""
    column = F.col(column) if isinstance(column, str) else column
    return column != ""


def replace_words(column: str | Column, words: Mapping[str, str]) -> Column:
    """Replace whole words (bounded by anything but ASCII letters, digits, underscore)."""
    column = F.col(column) if isinstance(column, str) else column
    for old, new in words.items():
        pattern = r"(?<![A-Za-z0-9_])\Q" + old + r"\E(?![A-Za-z0-9_])"
        column = F.regexp_replace(column, F.lit(pattern), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return column


def severity_rank(column: str | Column) -> Column:
    """1 for the worst severity, growing as it gets milder."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(column) if isinstance(column, str) else column)


def comparable(df: DataFrame) -> DataFrame:
    """The same rows with map and variant columns in a form that can be grouped."""
    changed = {}
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        name = "`" + field.name.replace("`", "``") + "`"
        if kind == "map":
            changed[field.name] = F.array_sort(F.map_entries(F.col(name)))
        elif kind == "variant":
            changed[field.name] = F.to_json(F.col(name))
    return df.withColumns(changed) if changed else df


def missing_as_null(df: DataFrame) -> DataFrame:
    """The same rows with null in place of NaN, which data frames take for missing too."""
    changed = {}
    for field in df.schema.fields:
        if field.dataType.typeName() in ("float", "double"):
            value = F.col("`" + field.name.replace("`", "``") + "`")
            changed[field.name] = F.when(~F.isnan(value), value)
    return df.withColumns(changed) if changed else df


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over the columns by name; nulls and empty texts differ."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
