"""Exact largest inner products: vectors by descending length, pruned by partial sums in a rotated space.

Vectors are integers, ``floor(256 * x)``. All are put in order of length and cut into blocks of
bounded size; queries are cut into blocks too, and a pair of blocks is one unit of work. The
block of the longest vectors gives every query a first threshold, its ``k``-th best score
there. A pair of blocks is left out if no query's length times the block's greatest length
reaches the threshold. In a pair, both sides are turned by the right singular vectors of
all vectors, so that a few leading components hold most of each product; by Cauchy-Schwarz the rest
is at most the product of the lengths of what remains. What that bound can't exclude is
worked out exactly in integers, and thresholds rise from one run of vectors to the next.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter ones
count as padded with zeros; scores are exact while they fit a long. A query's own row is any row
with its id; a query row that repeats wholly is one query; a null id is no query, and as a candidate ranks
after other ids of its score; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import numbered
from tablesmith.session import stage

TOP = 5
VECTORS_PER_BLOCK = 4096
QUERIES_PER_BLOCK = 512
RUN = 512
EXACT_AT_ONCE = 1 << 16
NO_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
#: Part of the components that the partial sums take.
LEADING = 4
SLACK = 1e-6


def integers(embedding: Column) -> Column:
    """The components as integers, null if the vector takes no part."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("bigint"))
    return F.when(~bad, whole)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    out = np.zeros((len(column), size), np.int64)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), lengths)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """The right singular vectors of all vectors, strongest first, from sums of products per task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            rows = matrix(batch.column(0), size).astype(float)
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["cell", "sum"])

    sums = vectors.select("ints").mapInArrow(work, "cell bigint, sum double").groupBy("cell").agg(F.sum("sum").alias("sum"))
    total = np.zeros(size * size)
    for cell, value in sums.collect():  # the square of the number of components
        total[cell] = value
    return np.linalg.eigh(total.reshape(size, size))[1][:, ::-1].copy()


def _packed(rows: DataFrame, block: str, size: int) -> DataFrame:
    """One row per block: ids and components as bytes, by descending length."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("place").combine_chunks()
        ids = group.column("vec_id").fill_null(NO_ID).to_numpy()
        ints = matrix(group.column("ints").combine_chunks(), size)
        longest = float(np.sqrt((ints[0].astype(float) ** 2).sum())) if block == "vblock" else 0.0
        return pa.table({block: group.column(block).slice(0, 1), "ids": [ids.tobytes()], "ints": [ints.tobytes()], "longest": [longest]})

    return rows.groupBy(block).applyInArrow(pack, f"{block} bigint, ids binary, ints binary, longest double")


class Search:
    """The best ``k`` of one block of vectors for one block of queries."""

    def __init__(self, size: int, turn: np.ndarray, k: int) -> None:
        self.size, self.turn, self.k, self.lead = size, turn, k, max(1, size // LEADING)

    def unpack(self, ids: bytes, ints: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(ids, np.int64), np.frombuffer(ints, np.int64).reshape(-1, self.size)

    def best(self, queries: tuple, vectors: tuple, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of the best, given what score each query asks for at least."""
        (q_ids, q), (v_ids, v) = queries, vectors
        q_turned, v_turned = q @ self.turn, v @ self.turn
        q_rest = np.linalg.norm(q_turned[:, self.lead :], axis=1)
        v_rest = np.linalg.norm(v_turned[:, self.lead :], axis=1)
        q_length, v_length = np.linalg.norm(q_turned, axis=1), np.linalg.norm(v_turned, axis=1)
        least = least.astype(float)
        found = (np.zeros(0, np.int64),) * 3
        for at in range(0, len(v), RUN):
            run = slice(at, at + RUN)
            slack = SLACK * (1.0 + q_length * v_length[run][0])
            if not (q_length * v_length[run][0] + slack >= least).any():
                break  # the vectors that follow are no longer
            bound = q_turned[:, : self.lead] @ v_turned[run, : self.lead].T + q_rest[:, None] * v_rest[run]
            who, what = np.nonzero(bound + slack[:, None] >= least[:, None])
            other = q_ids[who] != v_ids[run][what]
            who, what = who[other], what[other] + at
            score = np.concatenate([(q[who[i : i + EXACT_AT_ONCE]] * v[what[i : i + EXACT_AT_ONCE]]).sum(axis=1) for i in range(0, max(1, len(who)), EXACT_AT_ONCE)])
            found = self.kept(*(np.concatenate(pair) for pair in zip(found, (who, v_ids[what], score))))
            full = np.bincount(found[0], minlength=len(q)) >= self.k
            worst = np.full(len(q), LEAST)
            worst[found[0]] = found[2]  # the last of a query is its worst
            least = np.where(full, np.maximum(least, worst), least)
        return found

    def kept(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, who))
        who, ids, score = who[order], ids[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        return tuple(x[place < self.k] for x in (who, ids, score))


def largest_products(vectors: DataFrame, is_query: Column, k: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score) from (vec_id, embedding)."""
    rows = vectors.select("vec_id", integers(F.col("embedding")).alias("ints"), is_query.alias("asks")).where("ints is not null")
    squares = F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    rows = stage(rows.withColumn("length", F.sqrt(squares)), "vectors")
    size = max(1, rows.agg(F.max(F.size("ints"))).first()[0] or 0)
    turn = rotation(rows, size)
    search = Search(size, turn, k)

    by_length = numbered(rows, [F.col("length").desc(), F.col("vec_id").asc_nulls_last(), F.col("ints")])
    blocks = by_length.withColumn("vblock", F.floor(F.col("place") / VECTORS_PER_BLOCK))
    vector_blocks = stage(_packed(blocks.select("vblock", "vec_id", "ints", "place"), "vblock", size), "vector-blocks")
    asking = rows.where("asks and vec_id is not null").select("vec_id", "ints").distinct()
    placed = numbered(asking, [F.col("vec_id"), F.col("ints")]).withColumn("qblock", F.floor(F.col("place") / QUERIES_PER_BLOCK))
    query_blocks = _packed(placed.select("qblock", "vec_id", "ints", "place"), "qblock", size).drop("longest")

    longest = vector_blocks.where("vblock = 0").select("ids", "ints").first()  # one block

    def first_thresholds(group: pa.Table) -> pa.Table:
        queries = search.unpack(group.column("ids")[0].as_py(), group.column("ints")[0].as_py())
        none = np.full(len(queries[0]), LEAST)
        least = none.copy()
        who, _, score = search.best(queries, search.unpack(longest.ids, longest.ints), none)
        full = np.bincount(who, minlength=len(least)) >= k
        least[who] = score
        least = np.where(full, least, LEAST)
        lengths = np.linalg.norm(queries[1].astype(float), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # the length from which on a vector may still count for some query of the block
            needed = np.where((least > 0) & (lengths > 0), least / lengths, 0.0)
        return group.append_column("least", pa.array([least.tobytes()], pa.binary())).append_column("needed", pa.array([float(needed.min() * (1 - SLACK))]))

    if longest is None:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("bigint").alias("score"))
    asked = stage(query_blocks.groupBy("qblock").applyInArrow(first_thresholds, "qblock bigint, ids binary, ints binary, least binary, needed double"), "query-blocks")
    count = asked.count()
    every = F.explode(F.sequence(F.lit(0), F.lit(max(count - 1, 0)).cast("bigint")))
    pairs = vector_blocks.select("vblock", "longest", every.alias("qblock")).join(asked.select("qblock", "needed"), "qblock").where("longest >= needed")
    pairs = stage(pairs.select("vblock", "qblock"), "pairs")
    left = vector_blocks.join(pairs, "vblock").select("vblock", "qblock", "ids", "ints")
    right = asked.join(pairs, "qblock").select("vblock", "qblock", "ids", "ints", "least")

    def score(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        queries = search.unpack(theirs.column("ids")[0].as_py(), theirs.column("ints")[0].as_py())
        block = search.unpack(mine.column("ids")[0].as_py(), mine.column("ints")[0].as_py())
        who, ids, scores = search.best(queries, block, np.frombuffer(theirs.column("least")[0].as_py(), np.int64))
        return pa.table({"query_id": pa.array(queries[0][who]), "vec_id": pa.array(ids, mask=ids == NO_ID), "score": pa.array(scores)})

    keys = ["vblock", "qblock"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id bigint, vec_id bigint, score bigint")
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
