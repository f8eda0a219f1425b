"""Splitting hot groups so that ordered work never sits in one task.

A window over a group sorts the whole group in one task. That is fine for small
groups and hopeless for a group that holds a third of all rows, or for a window
without any group. ``find_splits`` samples the rows once and picks split points
inside such groups only. The points become literals, so every branch of a plan,
and every retry of a task, puts a row into the same block. An operator then works
per block and brings along what earlier blocks hand over: one row per block, a
number bounded by the number of split points.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS_PER_PARTITION = 2
SAMPLES_PER_BLOCK = 32
FEW_POINTS = 40
#: Longest text kept in a split point; a beginning splits as well as the whole.
POINT_CHARS = 200


@dataclass(frozen=True)
class Splits:
    """Sorted split points over ``by + order``, all inside groups worth splitting."""

    by: tuple[str, ...]
    order: tuple[str, ...]
    types: tuple[str, ...]
    points: tuple[tuple[str | None, ...], ...]

    def __bool__(self) -> bool:
        return bool(self.points)

    def block(self) -> Column:
        """Twice the number of points below the row, plus one on a point.

        Groups without points lie between two points as a whole, so in one block.
        """
        if len(self.points) <= FEW_POINTS:
            place = F.expr(self._compare(0, len(self.points)))
        else:
            place = self._search(self.points, "2 * {at} - int({on_point})")
        return F.coalesce(place, F.lit(0))  # never null, so no join adds a null test that works it out again

    def with_block(self, df: DataFrame, name: str) -> DataFrame:
        """The rows with their :meth:`block` as column ``name``.

        With many points each halving step is a projection of its own. Their columns keep Spark from folding them into
        one expression, so all steps are compiled; the lambda of ``block`` is interpreted, row by row and step by step.
        """
        if len(self.points) <= FEW_POINTS:
            return df.withColumn(name, self.block())
        row, known = f"{name}_row", f"{name}_known"
        values = "array(" + ", ".join(_struct(map(_literal, point, self.types)) for point in self.points) + ")"
        df = df.withColumns({row: F.expr(_struct(map(_quoted, self.by + self.order))), known: F.expr(values), name: F.lit(0)})
        at = F.col(name)
        for i in reversed(range(len(self.points).bit_length())):
            df = df.withColumn(name, F.when(F.get(known, at + (2**i - 1)) <= F.col(row), at + 2**i).otherwise(at))
        on_point = (at > 0) & F.get(known, at - 1).eqNullSafe(F.col(row))
        return df.withColumn(name, 2 * at - F.when(on_point, 1).otherwise(0)).drop(row, known)

    def _compare(self, low: int, high: int) -> str:
        """Nested comparisons: compiled code, and quick as long as there are few."""
        if low == high:
            return str(2 * low)
        middle = (low + high) // 2
        equal, below = "true", "false"
        terms = list(zip(map(_quoted, self.by + self.order), self.points[middle], self.types))
        for name, value, kind in reversed(terms):
            same = f"{name} <=> {_literal(value, kind)}"
            less = "false" if value is None else f"coalesce({name} < {_literal(value, kind)}, true)"
            below = less if below == "false" else f"({less} OR ({same} AND {below}))"
            equal = same if equal == "true" else f"{same} AND {equal}"
        return (
            f"CASE WHEN {equal} THEN {2 * middle + 1} WHEN {below} THEN {self._compare(low, middle)}"
            f" ELSE {self._compare(middle + 1, high)} END"
        )

    def in_split_group(self) -> Column:
        """True for rows of the groups that were split."""
        if not self.by:
            return F.lit(True)
        groups = dict.fromkeys(point[: len(self.by)] for point in self.points)
        if not groups:
            return F.lit(False)
        known = ", ".join(_struct(map(_literal, group, self.types)) for group in groups)
        return F.expr(f"{_struct(map(_quoted, self.by))} IN ({known})")  # a set, compiled; nulls inside of structs are equal

    def _search(self, values: Sequence[tuple[str | None, ...]], result: str) -> Column:
        """Halve the sorted values until it is known how many are up to the row; nulls sort first."""
        row = _struct(map(_quoted, self.by + self.order))
        known = "array(" + ", ".join(_struct(map(_literal, value, self.types)) for value in values) + ")"
        steps = ", ".join(str(2**i) for i in reversed(range(len(values).bit_length())))
        count = len(values)
        at, step = "__blocks_at", "__blocks_step"  # a lambda name would hide a column of that name
        on_point = f"({at} > 0 AND element_at({known}, greatest({at}, 1)) <=> {row})"
        return F.expr(
            f"aggregate(array({steps}), 0, ({at}, {step}) -> CASE WHEN {at} + {step} > {count} THEN {at}"
            f" WHEN element_at({known}, {at} + {step}) <= {row} THEN {at} + {step} ELSE {at} END, {at} -> "
            + result.format(at=at, on_point=on_point)
            + ")"
        )


def _struct(values: Iterable[str]) -> str:
    return "named_struct(" + ", ".join(f"'c{i}', {value}" for i, value in enumerate(values)) + ")"


def _literal(value: str | None, kind: str) -> str:
    if value is None:
        return f"CAST(NULL AS {kind})"
    text = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"CAST('{text}' AS {kind})"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def find_splits(
    df: DataFrame,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    rows_per_block: int | None = None,
    rows: int | None = None,
    point_chars: int | None = POINT_CHARS,
) -> Splits:
    """Split points for groups of ``by`` that hold more than about one block of rows.

    There are a few blocks for each shuffle partition, whatever the size of the table, so blocks
    grow and shrink with what a task is meant to hold. Runs a count, unless ``rows`` gives it, and collects one thin
    sample of the key columns, a few dozen keys per block, texts cut to ``point_chars``.
    """
    by, order = tuple(by), tuple(order)
    schema = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    types = tuple(schema[c] for c in by + order)
    none = Splits(by, order, types, ())
    keys = df.select(*by, *order)
    rows = keys.count() if rows is None else rows
    blocks = BLOCKS_PER_PARTITION * shuffle_partitions(df) if rows_per_block is None else rows // rows_per_block
    if blocks < 2 or not rows:
        return none
    wanted = blocks * SAMPLES_PER_BLOCK
    cut = [c for c in order if schema[c] == "string" and point_chars]
    sample = (
        keys.sample(fraction=min(1.0, wanted / rows), seed=17)
        .withColumns({c: F.substring(_quoted(c), 1, point_chars) for c in cut})
        .select("*", *[F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(by + order)])
        .orderBy(*by, *order)
        .select(*[f"_s{i}" for i in range(len(types))])
        .collect()
    )
    return Splits(by, order, types, _points([tuple(r) for r in sample], len(by)))


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _points(sample: list[tuple], by: int) -> tuple[tuple, ...]:
    """Every n-th sampled row of the groups that fill at least one block."""
    sizes: dict[tuple, int] = {}
    for row in sample:
        sizes[row[:by]] = sizes.get(row[:by], 0) + 1
    seen: dict[tuple, int] = {}
    points = []
    for row in sample:
        group = row[:by]
        seen[group] = seen.get(group, 0) + 1
        if sizes[group] >= SAMPLES_PER_BLOCK and seen[group] % SAMPLES_PER_BLOCK == 0:
            points.append(row)
    return tuple(dict.fromkeys(points))


def salt(df: DataFrame) -> Column:
    """A spread of rows by their place in the input, so that equal rows spread too; there are as many salts as shuffle partitions."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_partitions(df)))


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_key: int | None = None) -> Splits:
    """The key values, null among them, that fill more than about one block of rows on their own, as points."""
    splits = find_splits(df, keys, (), rows_per_key, point_chars=None)
    return Splits(splits.by, (), splits.types, tuple(dict.fromkeys(splits.points)))
