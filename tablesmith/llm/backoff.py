"""Language-model scores by stupid backoff, with counts of n-grams over the whole corpus.

A word scores as the count of its n-gram over the count of the n-gram without it, if that
n-gram counts, else ``ALPHA`` times its score with one word of context fewer; a word without context scores as
its share of all words. N-grams longer than a word count from ``LEAST_COUNT`` occurrences on.

Texts are gathered in blocks of a few megabytes. A block explodes into its distinct n-grams, as
64-bit hashes with counts, dealt by ranges of the hash: sorted, as differences, compressed.
A range's task adds all blocks up to its part of the count table, joins that to each
block's n-grams and sends the counts back to the block, where they are summed per document. Rows that are
shuffled so follow the distinct n-grams of a block, not the occurrences.

Defined cases: a null text is an empty one; a text without words has a score of 0 and no mean; rows that repeat
count as often as they occur and keep their own result; null ids stay null; an empty table
gives an empty result. Other columns are not read. Two n-grams of one hash, one pair in 10**19, count as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import mix, partitions, slices, word_hashes
from tablesmith.session import stage

ORDER = 2
ALPHA = 0.4
LEAST_COUNT = 2
BLOCK_BYTES = 8 << 20
#: Text per range of hashes, about: so many bytes' n-grams meet in one task.
RANGE_BYTES = 16 << 20


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams that end at each word, for 1 to ``order`` words, 0 where a text has too few before; and words per text."""
    hashes, sizes = word_hashes(texts)
    hashes[hashes == 0] = 1
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    found = [hashes]
    for n in range(2, order + 1):
        longer = np.zeros_like(hashes)
        longer[1:] = mix(found[-1][:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:] + np.uint64(n))
        longer[longer == 0] = 1
        longer[place < n - 1] = 0
        found.append(longer)
    return found, sizes


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _planes(values: np.ndarray) -> bytes:
    """Differences of sorted hashes, byte by byte place, so that the leading zeros lie together."""
    steps = np.diff(values, prepend=np.uint64(0))
    return _pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def _from_planes(data: bytes) -> np.ndarray:
    planes = _unpack(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, rows): the documents by a few megabytes, compressed, written once, so that a block stays what it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for at, batch in enumerate(slices(batches, size=BLOCK_BYTES)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([first + at]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

    return stage(docs.select("doc_id", "text").mapInArrow(work, "block bigint, rows binary"), "blocks")


def _documents(rows: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(rows)))


def scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, least: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score), natural logarithms, for every row."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(partitions(docs), -(-size // RANGE_BYTES))
    bounds = np.array([(i << 64) // ranges for i in range(ranges + 1)][:-1], np.uint64)
    blocks = _blocks(docs)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, rows in zip(batch.column("block").to_pylist(), batch.column("rows")):
                found, _ = grams(_documents(rows.as_py()).column("text"), order)
                for n, hashes in enumerate(found, 1):
                    distinct, counts = np.unique(hashes[hashes != 0], return_counts=True)
                    cuts = np.append(np.searchsorted(distinct, bounds), len(distinct))
                    full = np.flatnonzero(np.diff(cuts))
                    packed = [(_planes(distinct[cuts[p] : cuts[p + 1]]), _pack(counts[cuts[p] : cuts[p + 1]].astype(np.int32))) for p in full]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(full * order + (n - 1)),
                            pa.array(np.full(len(full), block)),
                            pa.array([h for h, _ in packed], pa.binary()),
                            pa.array([c for _, c in packed], pa.binary()),
                        ],
                        ["part", "block", "hashes", "counts"],
                    )

    def count(group: pa.Table) -> pa.Table:
        """The part of the count table, joined to the n-grams of each block."""
        hashes = [_from_planes(x) for x in group.column("hashes").to_pylist()]
        counts = np.concatenate([_unpack(x, np.int32) for x in group.column("counts").to_pylist()])
        ends = np.cumsum([len(x) for x in hashes])
        distinct, where = np.unique(np.concatenate(hashes), return_inverse=True)
        del hashes
        total = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)
        answers = [_pack(x) for x in np.split(total[where], ends[:-1])]
        return pa.table({"block": group.column("block"), "part": group.column("part"), "totals": pa.array(answers, pa.binary())})

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        batches = [_documents(x) for x in texts.column("rows").to_pylist()]
        totals: list[list] = [[] for _ in range(order)]
        for part, data in sorted(zip(answers.column("part").to_pylist(), answers.column("totals").to_pylist())):
            totals[part % order].append(_unpack(data, np.int64))
        (rows,) = batches
        found, sizes = grams(rows.column("text"), order)
        known = [np.zeros(len(found[0]), np.int64) for _ in found]
        for n, hashes in enumerate(found):
            used = hashes != 0
            _, where = np.unique(hashes[used], return_inverse=True)
            if len(where):
                known[n][used] = np.concatenate(totals[n])[where]
        logs, alone = backed_off(known, alpha, least)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return pa.table(
            {
                "doc_id": rows.column("doc_id"),
                "n_words": pa.array(sizes.astype(np.int64)),
                "partial": pa.array(np.bincount(owner, weights=logs, minlength=len(sizes))),
                "alone": pa.array(np.bincount(owner, weights=alone, minlength=len(sizes)).astype(np.int64)),
            }
        )

    exploded = blocks.mapInArrow(explode, "part bigint, block bigint, hashes binary, counts binary")
    counted = exploded.groupBy("part").applyInArrow(count, "block bigint, part bigint, totals binary")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words bigint, partial double, alone bigint").fields])
    summed = stage(blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(score, schema), "scores")
    words = summed.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("partial") - F.col("alone") * F.lit(float(np.log(max(1, words))))
    return summed.select("doc_id", "n_words", log_score.alias("log_score"), (log_score / F.nullif("n_words", F.lit(0))).alias("mean_log_score"))


def backed_off(known: list[np.ndarray], alpha: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word the logarithm of its score, but for the number of all words, and whether that belongs in it."""
    logs = np.log(np.maximum(known[0], 1).astype(float))
    alone = np.ones(len(logs), bool)
    place_has = [k > 0 for k in known]
    for n in range(1, len(known)):
        context = np.concatenate(([0], known[n - 1][:-1]))
        counts = known[n] >= least
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.log(known[n].astype(float)) - np.log(context.astype(float))
        # words with too few words before them have no such n-gram and stay as they are, without a penalty
        logs = np.where(counts, ratio, np.where(place_has[n], logs + np.log(alpha), logs))
        alone &= ~counts
    return logs, alone
