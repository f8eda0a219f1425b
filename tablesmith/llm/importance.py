"""Quality by importance resampling: the likelihood of a text under a model of target text against that of raw text.

Both models are chances of hashed words and word pairs. Raw counts cover all documents, target counts
a bounded sample of documents labelled good. A document's log ratio gets Gumbel noise from
a digest of the row, and the ``k`` largest sums are a sample without replacement by
importance. ``k`` is the number of documents whose ratio passes a bound set on other labelled rows.

Defined cases: a text that is null or has no word has ratio 0; labels that are null, or
repeat with other values, count as they stand, row by row; documents that tie with the last
one taken are all taken, so rows that repeat share their fate; without labels of both sorts
the bound is minus infinity and all documents stay; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import fresh, mix, slices, uniform, word_hashes
from tablesmith.session import stage

#: Words have one half of the buckets, word pairs the other.
BUCKETS = 1 << 18
#: Documents that train the target model, and others that set the bound, at most about so many of each label.
SAMPLE_DOCS = 20_000
#: Counts as the raw model expects them that each bucket of the target model starts with.
PRIOR = 4.0
MARGIN = 0.5
SIGMAS = 4.0
#: A good document lost weighs as much as so many others kept.
LOSS = 5.0
#: Ratios are whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
DIGITS = 16


@dataclass(frozen=True)
class Sampler:
    """What decides: the ratio of each bucket, and the least sum of ratio and noise that is taken; and (doc_id, log_ratio, value) of all rows."""

    ratios: np.ndarray
    least: float
    rated: DataFrame


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of all texts, text by text, and the number in each text."""
    hashes, words = word_hashes(texts)
    half, ends = np.uint64(BUCKETS // 2), np.cumsum(words)
    sizes = np.maximum(2 * words - 1, 0)
    found = np.empty(sizes.sum(), np.int32)
    # the words of a text, then its pairs: each goes where it belongs, so that nothing is sorted
    at = np.arange(len(hashes)) + np.repeat(np.cumsum(sizes) - sizes - (ends - words), words)
    found[at] = hashes % half
    at += np.repeat(words, words)
    pair = np.ones(len(hashes), bool)
    pair[ends[words > 0] - 1] = False
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15)
    pairs += hashes[1:]
    found[at[pair]] = half + mix(pairs[pair[:-1]]) % half
    return found, sizes


def counts(docs: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the documents; a task sends each of its buckets once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches):
            total += np.bincount(buckets(batch.column("text"))[0], minlength=BUCKETS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    total = np.zeros(BUCKETS, np.int64)
    summed = docs.select("text").mapInArrow(work, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = summed.toArrow()  # one row per bucket
    total[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return total


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log of target chance over raw chance, in which half of the raw text lies below 0 and half above.

    Chances are known up to a factor, as sampling needs no more: with totals for factors, text that the target lacks
    would lift all other words a little, and long documents a lot. A bucket with few expected counts is
    pulled towards 0. A ratio within the margin is 0, as a mere shift of languages or topics makes that much, and so
    is one that chance explains.
    """
    factor = np.empty(BUCKETS)
    for part in (slice(0, BUCKETS // 2), slice(BUCKETS // 2, BUCKETS)):
        used = np.flatnonzero(raw[part])
        share = target[part][used] / raw[part][used]
        order = np.argsort(share, kind="stable")
        half = np.searchsorted(np.cumsum(raw[part][used][order]), raw[part].sum() / 2)
        factor[part] = share[order][half] if len(used) else 0.0
    expected = raw * factor
    ratios = np.log((target + PRIOR) / (expected + PRIOR))
    beyond = np.sign(ratios) * np.maximum(np.abs(ratios) - MARGIN, 0.0)
    beyond[np.abs(target - expected) <= SIGMAS * np.sqrt(expected + PRIOR)] = 0.0
    return np.round(beyond * UNIT).astype(np.int64)


def scored(docs: DataFrame, ratios: np.ndarray, name: str = "log_ratio") -> DataFrame:
    """The documents with the sum of ratios over their words and word pairs."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, sizes = buckets(batch.column("text"))
            sums = np.zeros(len(found) + 1, np.int64)
            np.cumsum(ratios[found], out=sums[1:])
            ends = np.cumsum(sizes)
            score = (sums[ends] - sums[ends - sizes]) / UNIT
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, name])

    return docs.mapInArrow(work, schema)


def noise() -> Column:
    """Gumbel noise of a row, by digest of id and text."""
    return -F.log(-F.log(uniform("doc_id", "text", seed=7)))


def _chosen(labels: DataFrame, good: bool, part: int) -> DataFrame:
    """Ids of about SAMPLE_DOCS rows of a label, from one half of all ids by digest."""
    clean = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    digest = F.xxhash64("doc_id", F.lit(11))
    rows = labels.where("doc_id is not null and quality is not null").where(clean if good else ~clean).where(F.pmod(digest, F.lit(2)) == part)
    share = min(1.0, SAMPLE_DOCS / max(1, rows.count()))
    return rows.where(F.pmod(F.shiftright(digest, 1), F.lit(1 << 40)) < int(share * (1 << 40))).select("doc_id", F.lit(good).alias("good")).distinct()


def bound(ratios: np.ndarray, good: np.ndarray) -> float:
    """Where the shares of good documents lost, which weigh more, and of others kept are least in sum; the middle of the gap there."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(ratios, kind="stable")
    ratios, good = ratios[order], good[order]
    lost = np.concatenate(([0], np.cumsum(good))) / good.sum()
    kept = 1 - np.concatenate(([0], np.cumsum(~good))) / (~good).sum()
    edges = np.concatenate(([ratios[0] - 2.0], (ratios[1:] + ratios[:-1]) / 2, [ratios[-1] + 2.0]))
    return float(edges[np.argmin(LOSS * lost + kept)])


def kth_largest(values: DataFrame, k: int) -> float:
    """The ``k``-th largest of the doubles in ``value``, by counts per leading bits; each round is one small sum."""
    low, high = values.agg(F.min("value"), F.max("value")).first()
    steps = 1 << DIGITS
    while low < high:
        width = (high - low) / steps
        if low + width <= low or high - width >= high:
            break
        place = F.least(F.floor((F.col("value") - low) / width), F.lit(steps - 1))
        inside = values.where(F.col("value").between(low, high)).groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for row in sorted(inside.collect(), reverse=True):  # at most 2**DIGITS rows
            if k <= row.n:
                low, high = row.low, row.high
                break
            k -= row.n
    return high if k <= 1 else low


def sampler(docs: DataFrame, labels: DataFrame, k: int | None = None) -> Sampler:
    """Models from the documents and labels, and the sum of ratio and noise that the ``k``-th document has."""
    target_ids = _chosen(labels, True, 0)
    target = docs.join(F.broadcast(target_ids), "doc_id", "left_semi")
    ratios = log_ratios(counts(target), counts(docs))
    rated = stage(scored(docs.select("doc_id", "text"), ratios).select("doc_id", "log_ratio", (F.col("log_ratio") + noise()).alias("value")), "rated")
    if k is None:
        others = _chosen(labels, True, 1).unionByName(_chosen(labels, False, 1))
        held = rated.join(F.broadcast(others), "doc_id").select("log_ratio", "good").toPandas()  # two bounded samples
        edge = bound(held["log_ratio"].to_numpy(), held["good"].to_numpy(bool))
        k = rated.where(F.col("log_ratio") > edge).count()
    total = rated.count()
    least = float("-inf") if k >= total else float("inf") if k <= 0 else kth_largest(rated.select("value"), k)
    return Sampler(ratios, least, rated)


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """(doc_id, log_ratio, noisy_ratio) of the documents taken."""
    model = sampler(docs, labels, k)
    return model.rated.where(F.col("value") >= model.least).withColumnRenamed("value", "noisy_ratio")


def filtered(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The documents taken, with all their columns; each is rated where it is read, so texts aren't shuffled."""
    model, name = sampler(docs, labels, k), fresh(docs, "log_ratio")
    return scored(docs, model.ratios, name).where(F.col(name) + noise() >= model.least).drop(name)
