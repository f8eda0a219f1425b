"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target divided by its size is the number of times its documents are expected:
the whole part is taken for sure, the fraction is an inclusion probability. The flight
moves probabilities along the null space of two constraints, the number of documents and
the number of words, until all but two are 0 or 1. Three documents leave one direction,
(s3 - s2, s1 - s3, s2 - s1) for sizes s, so each step is a few operations. Sources are
cut into blocks of bounded size; what a block leaves open flies again with what other
blocks of the source left, until a source is one block, whose last two documents land
where the words come nearest to the target.

Weights 5, 2, 1 repeat over the sources by code point, null last. A target above twice its
source's size stops there, and the excess goes to the others by weight.

Defined cases: a null text has size 0, and nothing of it is taken; a null source is a source; null ids stay null; rows
that repeat wholly count as one unit that may be taken as often as twice its rows, dealt
evenly to them; an empty table gives an empty result. Steps depend on digests of the rows
only, so reruns agree.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import WORD, fresh, numbered, repeated
from tablesmith.session import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
BLOCK = 4096
NEAR = 1e-9
#: So many documents of all sizes of a source's last block don't fly, but land with what the flight leaves open.
LANDED = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target, sid) from (source, size): what each source should give.

    The level at which a weight of one would stand is raised until no further source
    reaches its limit; each round is one sum over the sources.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))).cast("int"))
    sources = numbered(totals, [F.col("source").asc_nulls_last()], "sid").withColumn("weight", weight)
    wanted = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    full, level, before = most * F.col("source_size"), 0.0, -1
    while True:
        above = F.col("weight") * level > full
        stopped, taken, open_weight = sources.agg(F.count_if(above), F.sum(F.when(above, full)), F.sum(F.when(~above, F.col("weight")))).first()
        if stopped == before or not open_weight:
            break
        before, level = stopped, (wanted - (taken or 0.0)) / open_weight
    return sources.select("source", "source_size", F.least(full, F.col("weight") * level).alias("target"), "sid")


def flight(chances: list[float], sizes: list[int], generator: random.Random) -> list[float]:
    """Chances moved to 0 or 1, all but two, with the sums of chances and of sizes times chances kept."""
    x, active, coming = list(chances), [], iter(range(len(chances)))
    while True:
        active = [i for i in active if 0.0 < x[i] < 1.0]
        for i in coming:
            if 0.0 < x[i] < 1.0:
                active.append(i)
                if len(active) == 3:
                    break
        if len(active) < 2:
            return x
        if len(active) == 3:
            a, b, c = (sizes[i] for i in active)
            way = [c - b, a - c, b - a]
            if not any(way):
                way = [1, -1, 0]
        elif sizes[active[0]] == sizes[active[1]]:
            way = [1, -1]
        else:
            return x
        up = min((1.0 - x[i]) / w if w > 0 else x[i] / -w for i, w in zip(active, way) if w)
        down = min(x[i] / w if w > 0 else (1.0 - x[i]) / -w for i, w in zip(active, way) if w)
        step = up if generator.random() * (up + down) < down else -down
        for i, w in zip(active, way):
            moved = x[i] + step * w
            x[i] = 0.0 if moved < NEAR else 1.0 if moved > 1.0 - NEAR else moved


def landing(chances: list[float], sizes: list[int]) -> list[float]:
    """The open chances set to 0 or 1 so that the words, and then the documents, come nearest to what is expected."""
    x = np.array(chances)
    open_ones = np.flatnonzero((x > 0) & (x < 1))
    weights = np.array(sizes, np.int64)[open_ones]
    choices = (np.arange(1 << len(open_ones))[:, None] >> np.arange(len(open_ones))) & 1
    words = np.abs(choices @ weights - x[open_ones] @ weights)
    documents = np.abs(choices.sum(axis=1) - x[open_ones].sum())
    x[open_ones] = choices[np.lexsort((documents, words.round(6)))[0]]
    return x.tolist()


def balanced(units: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, hit) from (sid, key, size, chance): 0 or 1 for each unit, balanced within each ``sid``."""
    state = units.select("sid", "key", "size", "chance")
    settled, level = [], 0
    while True:
        counts = state.groupBy("sid").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = state.join(counts, "sid").withColumn("block", F.pmod(F.xxhash64("key", F.lit(level)), F.col("blocks")))
        dealt = dealt.repartition("sid", "block")  # else blocks would stay where the join by source has put them
        flown = stage(dealt.groupBy("sid", "block").applyInArrow(_fly, "sid bigint, key string, size bigint, chance double"), "flight")
        open_one = (F.col("chance") > 0) & (F.col("chance") < 1)
        settled.append(flown.where(~open_one))
        state, level = flown.where(open_one), level + 1
        if state.isEmpty():
            break
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.select("key", F.col("chance").cast("int").alias("hit"))


def _fly(group: pa.Table) -> pa.Table:
    group = group.sort_by([("size", "descending"), ("key", "ascending")])
    sizes, chances = group.column("size").to_pylist(), group.column("chance").to_pylist()
    first = group.slice(0, 1).to_pylist()[0]
    grounded = set(np.linspace(0, len(chances) - 1, LANDED).astype(int).tolist()) if first["blocks"] == 1 else set()
    flying = [i for i in range(len(chances)) if i not in grounded]
    generator = random.Random(f"{first['sid']} {first['key']}")
    for i, chance in zip(flying, flight([chances[i] for i in flying], [sizes[i] for i in flying], generator)):
        chances[i] = chance
    if grounded:
        chances = landing(chances, sizes)
    kept = group.select(["sid", "key", "size"])
    return kept.append_column("chance", pa.array(chances, pa.float64()))


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, others: Sequence[str] = ()) -> DataFrame:
    """One row for equal documents: key, doc_id, size, source_size, target, copies and how often the mix takes them in all.

    ``key`` is what ``row_key`` gives for the other columns named.
    """
    rows = docs.select("doc_id", "source", row_key(others).alias("key"), word_count(F.col("text")).alias("size"))
    units = stage(rows.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("size").alias("size"), F.count("*").alias("copies")), "units")
    wanted = targets(units.select("source", (F.col("size") * F.col("copies")).alias("size")), weights, share, most)
    joined = units.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("copies")
    shared = stage(joined.withColumn("sure", F.floor(expected + NEAR)).withColumn("chance", F.greatest(expected - F.col("sure"), F.lit(0.0))), "shares")
    hits = balanced(shared.where((F.col("chance") > NEAR) & (F.col("size") > 0)))
    times = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("hit", F.lit(0))).otherwise(F.lit(0))
    return shared.join(hits, "key", "left").select("key", "doc_id", "size", "source_size", "target", "copies", times.cast("bigint").alias("times"))


def row_key(others: Sequence[str] = ()) -> Column:
    """A digest of id, source, text and the other columns named, equal for rows that agree in them."""
    parts = [F.col("doc_id").cast("string"), F.col("source"), F.col("text"), *[F.col("`" + c.replace("`", "``") + "`") for c in others]]
    return F.md5(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)])).cast("binary"))


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    planned = plan(docs, weights, share, most)
    each, over = F.floor(F.col("times") / F.col("copies")), F.col("times") % F.col("copies")
    dealt = F.array(
        F.struct((F.col("copies") - over).alias("rows"), each.alias("each")), F.struct(over.alias("rows"), (each + 1).alias("each"))
    )
    split = planned.withColumn("part", F.explode(dealt)).select(
        "doc_id", "size", "source_size", "target", (F.col("part.each") * F.col("size")).cast("bigint").alias("taken"), F.col("part.rows").alias("rows")
    )
    return repeated(split, "rows")


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The documents as often as the mix takes them."""
    key, times = fresh(docs, "mix_key"), fresh(docs, "mix_times")
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "source", "text")]
    planned = plan(docs, weights, share, most, others).where("times > 0").select(F.col("key").alias(key), F.col("times").alias(times))
    return repeated(docs.withColumn(key, row_key(others)).dropDuplicates([key]).join(planned, key).drop(key), times)
