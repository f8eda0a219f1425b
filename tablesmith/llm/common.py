"""What several operators share: whole texts in bounded slices, places in an order, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablesmith.session import stage

#: Words are runs of other characters than these six, as in all operators here.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES, HASHED_BYTES = 4 << 20, 1 << 19
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_BLANK = np.isin(np.arange(256), list(BLANKS))
#: What a byte of a word counts in its polynomial.
WEIGHT = np.where(IS_BLANK, 0, LOWER.astype(np.uint64) + np.uint64(1))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes not to clash with a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that ``column`` has about ``size`` bytes in each; a longer text is alone in one."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
        pa.default_memory_pool().release_unused()  # else a worker holds it while it waits for its next task


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs meanwhile hands Python so many rows at once at most, as both sides hold a batch whole; lazy plans that run later aren't concerned."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, A-Z as a-z, and the number of words of each text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    blank = IS_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins or ends
    edge[offsets] = True
    starts = np.flatnonzero(~blank & (np.concatenate(([True], blank[:-1])) | edge[:-1]))
    ends = np.flatnonzero(~blank & (np.concatenate((blank[1:], [True])) | edge[1:])) + 1
    hashes, at = np.zeros(len(starts), np.uint64), 0
    while at < len(starts):  # half a megabyte at once, which takes some 30 bytes for each
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + HASHED_BYTES, side="right")))
        hashes[at:stop] = _hashes(data, starts[at:stop], ends[at:stop])
        at = stop
    return hashes, np.diff(np.searchsorted(starts, offsets))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of the bytes of each word, mixed with its length."""
    data, ends, starts = data[starts[0] : ends[-1]], ends - starts[0], starts - starts[0]
    lengths = ends - starts
    longest = int(lengths.max())
    place = np.zeros(len(data), np.int32)
    place[starts] = starts
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(len(data), dtype=np.int32), place, out=place)
    np.minimum(place, longest, out=place)
    values = _powers(longest.bit_length())[place]
    values *= WEIGHT[data]
    return mix(np.add.reduceat(values, starts) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(bits: int) -> np.ndarray:
    factors = np.full((1 << bits) + 1, 0x100000001B3, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the finalizer of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def carried(items: Column, start: Column, step: Callable[[Column, Column], Column], result: Callable[[Column, Column], Column], shape: str, block: int = 256) -> Column:
    """An array of ``result(state, item)``, where ``state`` is what ``step`` made of ``start`` and the items before.

    An array that grows by an item at a time is copied each time, so results are gathered in blocks and blocks in an array of them.
    """

    def empty(kind: str) -> Column:
        return F.array().cast(kind)

    def add(state: Column, item: Column) -> Column:
        return F.struct(step(state["at"], item).alias("at"), F.concat(state["out"], F.array(result(state["at"], item).cast(shape))).alias("out"))

    def add_block(state: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(items, first, block), F.struct(state["at"].alias("at"), empty(f"array<{shape}>").alias("out")), add)
        return let(inner, lambda one: F.struct(one["at"].alias("at"), F.concat(state["out"], F.array(one["out"])).alias("out")))

    firsts = F.when(F.size(items) > 0, F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(block))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.aggregate(firsts, F.struct(start.alias("at"), empty(f"array<array<{shape}>>").alias("out")), add_block)["out"])


def repeated(df: DataFrame, times: str, block: int = 10_000) -> DataFrame:
    """Each row as often as column ``times`` says, without that column; no array is longer than a block or the number of blocks."""
    part, left = fresh(df, "part"), fresh(df, "left")
    blocks = F.sequence(F.lit(0), F.floor((F.col(times) - 1) / block).cast("int"))
    dealt = df.where(F.col(times) > 0).withColumn(part, F.explode(blocks))
    rest = F.least(F.lit(block), F.col(times) - F.col(part) * block).cast("int")
    return dealt.withColumn(left, F.explode(F.sequence(F.lit(1), rest))).drop(part, left, times)


def uniform(*columns: Column | str, seed: int = 0) -> Column:
    """A number between 0 and 1, both excluded, that depends on the columns only, so reruns agree."""
    digest = F.xxhash64(*[F.col(c) if isinstance(c, str) else c for c in columns], F.lit(seed))
    return (F.shiftrightunsigned(digest, 12).cast("double") + 0.5) / float(1 << 52)


def numbered(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """The rows with their place, from 0, in ``order``, which should tell all rows apart.

    Ranges of the order go to tasks of even size and are written once; a place is
    the place inside a range plus the rows before it, of which there is one number
    per range. Rows that ``order`` can't tell apart would share a range.
    """
    ranged = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    written = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftrightunsigned(F.col("_at"), 33)
    sizes = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return (
        written.withColumn("_part", part).join(F.broadcast(starts), "_part").select(*df.columns, place.alias(name))
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of the edges (a, b), longs: root is the smallest node reachable.

    Alternates between hanging larger neighbours and hanging smaller neighbours on the
    smallest one; each step is a minimum per node and a join, written to the shared
    folder. The number of steps grows with the logarithm of the longest path.
    """
    edges = stage(_oriented(edges).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        edges = stage(_hang_smaller(_hang_larger(edges)), "edges")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _oriented(edges: DataFrame) -> DataFrame:
    """The larger node first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _hang_larger(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hung = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.distinct()


def _hang_smaller(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    hung = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    digest = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(digest), F.sum(F.col("b").cast("decimal(38,0)"))).first())
