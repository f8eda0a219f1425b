"""Repeated passages by hashing units of lines: the earliest occurrence stays, others go, with their offsets.

A unit is a sentence of a line, or the line where it has no sentence end inside, so that a
passage set into the middle of a line is found too. Sentences of fewer than ``least`` words that follow each other,
over line ends too, make units that end where a sentence's digest is below those of both neighbours, so that runs which differ at first soon agree again.
Two characters of scripts without blanks count as a word. Units are compared after lower-casing with blanks
as one space. What stays under ``least`` words between longer units is too common to tell and stays; ``least=1`` takes everything.
Digests of 128 bits are grouped over all documents; occurrences rank by id and then offset.

Defined cases: a null text has no unit; null ids rank last; rows that share an id are one
document, so equal units at the same offset there are one occurrence and share its fate; an
empty table gives an empty result. ``cleaned`` keeps all columns of the documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import fresh, slices
from tablesmith.session import stage

BETWEEN = re.compile(r"(?<=[.!?])[^\S\n]+|(?<=[。！？])[^\S\n]*|\n+")
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]")
LEAST_WORDS = 6
BATCH_UNITS = 50_000


def weight(words: list[str]) -> int:
    """Words, where two characters of scripts without blanks are one."""
    return len(words) + sum(len(UNSPACED.findall(w)) // 2 for w in words if not w.isascii())


class Run:
    """Short sentences that make one unit, with the digests of the last two of the run."""

    def __init__(self, least: int) -> None:
        self.least, self.words, self.weight, self.digests = least, [], 0, ()

    def add(self, start: int, end: int, words: list[str], digest: int) -> None:
        self.start, self.end = self.start if self.words else start, end
        self.words.extend(words)
        self.weight += weight(words)
        self.digests = (*self.digests[-1:], digest)

    def may_end_before(self, digest: int) -> bool:
        """Whether the last sentence is the least of three and the unit is long enough."""
        return self.weight >= self.least and len(self.digests) == 2 and self.digests[1] < min(self.digests[0], digest)

    def close(self, goes_on: bool = False) -> Iterator[tuple[int, int, bytes]]:
        """The unit, if it is long enough; digests are kept if the run goes on."""
        if self.words and self.weight >= self.least:
            yield self.start, self.end, xxhash.xxh3_128_digest(" ".join(self.words))
        self.words, self.weight = [], 0
        if not goes_on:
            self.digests = ()


def units_of(text: str, least: int = LEAST_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of the units of a text, in code points."""
    start, run = 0, Run(least)
    for gap in chain(BETWEEN.finditer(text), (None,)):
        end = gap.start() if gap else len(text)
        words = text[start:end].lower().split()
        long = weight(words) >= least
        if long:
            yield from run.close()
            yield start, end, xxhash.xxh3_128_digest(" ".join(words))
        elif words:
            digest = xxhash.xxh3_64_intdigest(" ".join(words))
            if run.may_end_before(digest):
                yield from run.close(goes_on=True)
            run.add(start, end, words, digest)
        start = gap.end() if gap else end
    yield from run.close()


def units(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, digest) of all units."""
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", ids), *T.StructType.fromDDL("start bigint, end bigint, digest binary").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for unit in units_of(text or "", least):
                    at.append(row)
                    found.append(unit)
                    if len(found) == BATCH_UNITS:
                        yield packed(batch, at, found)
                        at, found = [], []
            yield packed(batch, at, found)

    def packed(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        starts, ends, digests = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(digests, pa.binary())],
            ["doc_id", "start", "end", "digest"],
        )

    return docs.select("doc_id", "text").mapInArrow(work, schema)


def _rank(id_column: str = "doc_id", start: str = "start") -> Column:
    return F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("doc_id"), F.col(start).alias("start"))


def repeats(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, end, first_doc_id, first_start) of every unit that occurs earlier.

    Texts are cut once. Both sides of the join are written tables, so that adaptive execution can split the units of a frequent digest.
    """
    found = stage(units(docs, least), "units")
    first = found.groupBy("digest").agg(F.min(_rank()).alias("first"), F.max(_rank()).alias("last")).where("first <> last")
    again = found.join(stage(first.select("digest", "first"), "firsts"), "digest").where(~_rank().eqNullSafe(F.col("first")))
    return again.select("doc_id", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def cleaned(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """The documents without repeated units; ``removed`` lists them as (start, end) in the original text."""
    removed, key = fresh(docs, "removed"), fresh(docs, "removed_of")
    spans = repeats(docs, least).select(F.col("doc_id").alias(key), F.struct("start", "end").alias("span"))
    lists = spans.groupBy(key).agg(F.array_sort(F.collect_set("span")).alias(removed))  # of one document each
    joined = docs.join(lists, docs["doc_id"].eqNullSafe(lists[key]), "left").drop(key)

    def keep(state: Column, span: Column) -> Column:
        before = F.substring(F.col("text"), (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(span["end"].alias("at"), F.concat(state["out"], F.array(before)).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(F.col("text"), (s["at"] + 1).cast("int"), F.char_length("text")))
    text = F.when(F.col(removed).isNull(), F.col("text")).otherwise(F.aggregate(F.col(removed), start, keep, rest))
    return joined.withColumn("text", text).withColumn(removed, F.coalesce(removed, F.array().cast("array<struct<start:bigint,end:bigint>>")))
