"""SimHash near-duplicates: fingerprints, and links within a Hamming distance through vantage points.

A fingerprint bit is set where over half of a text's shingle hashes have it. Equal
fingerprints collapse first. A vantage-point tree, built on a bounded sample, then deals
the distinct fingerprints to shards: each inner vertex compares the distance to its
vantage point with a bound, and by the triangle inequality two fingerprints within
``radius`` differ by at most ``radius`` in that distance. So it is enough that the
``radius`` distances around the bound go to both sides: every pair to be linked meets
in a shard. A shard emits no pairs, only a link from each fingerprint to the smallest one
that it reaches there, and links of all shards are joined to components.

Defined cases: a null text is an empty one, whose fingerprint is zero and links like any
other; rows that repeat keep their own row of the result; a null id takes part, but is the
id of a component only if all ids there are null; an empty table gives an empty result.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import HASHED_BYTES, batches_of, components, fresh, mix, slices, word_hashes
from tablesmith.session import stage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE, HASHES_AT_ONCE = 1 << 16, 1 << 15
SHARD = 2000
SAMPLED_PER_SHARD = 24
MAX_SAMPLE = 1_000_000
PIVOTS_TRIED = 8


def shingle_hashes(data: bytes, words: int, seed: int, distinct: bool) -> Iterator[np.ndarray]:
    """XXH64 of the shingles of one text, in arrays of bounded size."""
    tokens = data.translate(LOWER).split()
    if not tokens:
        return
    if distinct:
        tokens = sorted(set(tokens))
    width = min(words, len(tokens))
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    for at in range(0, len(begins), PIECE):
        pairs = zip(begins[at : at + PIECE], ends[at : at + PIECE])
        yield np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")


def fingerprint(data: bytes, words: int = 3, seed: int = 42, distinct: bool = False) -> int:
    """The 64 bits that over half of the shingle hashes have."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(data, words, seed, distinct):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
        total += len(hashes)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, words: int = 3, seeds: Sequence[int] = (42,), distinct: bool = False, keep: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The kept columns and f0, f1, ..., a signed 64-bit fingerprint per seed. ``distinct`` counts each word once, for single words."""
    names, keep = [f"f{i}" for i in range(len(seeds))], list(keep)
    fields = [*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in names]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            found = [pa.array(np.array([fingerprint(t, words, s, distinct) for t in texts], np.uint64).view(np.int64)) for s in seeds]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], [*keep, *names])

    return docs.select(*keep, "text").mapInArrow(work, T.StructType(fields))


def word_fingerprints(docs: DataFrame, seeds: Sequence[int], keep: Sequence[str]) -> DataFrame:
    """The kept columns and f0, f1, ..., a fingerprint per seed of the distinct words of a text.

    A word is hashed once and its hash mixed anew for each seed, for all texts of a slice at once.
    """
    names, keep = [f"f{i}" for i in range(len(seeds))], list(keep)
    fields = [*[docs.schema[c] for c in keep], *[T.StructField(n, T.LongType()) for n in names]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HASHED_BYTES):
            hashes, count = word_hashes(batch.column("text"))
            hashes, sizes = _distinct_of(hashes, np.repeat(np.arange(len(count)), count), len(count))
            found = [pa.array(_majorities(mix(hashes ^ mix(np.full(1, s, np.uint64))), sizes).view(np.int64)) for s in seeds]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *found], [*keep, *names])

    return docs.select(*keep, "text").mapInArrow(work, T.StructType(fields))


def _majorities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the 64 bits that over half of them have."""
    ones, owner = np.zeros((len(sizes), 64), np.int64), np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        here = owner[at : at + HASHES_AT_ONCE]
        bits = np.unpackbits(hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        ones[here[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.uint16)  # a run has fewer than that holds
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Tree:
    """Vantage points in arrays; a child below zero is a shard, as ``-1 - shard``."""

    def __init__(self, sample: np.ndarray, radius: int, least: int = SAMPLED_PER_SHARD) -> None:
        self.pivots, self.bounds, self.children, self.shards, self.radius = [], [], [], 0, radius
        self.root = self._grow(np.unique(sample), least)

    def _grow(self, sample: np.ndarray, least: int) -> int:
        split = self._split(sample) if len(sample) > least else None
        if split is None:
            self.shards += 1
            return -self.shards
        pivot, bound = split
        self.pivots.append(pivot)
        self.bounds.append(bound)
        self.children.append(None)
        at = len(self.pivots) - 1
        near, far = self._sides(sample, at)
        self.children[at] = (self._grow(sample[near], least), self._grow(sample[far], least))
        return at

    def _split(self, sample: np.ndarray) -> tuple[np.uint64, int] | None:
        """The vantage point and bound with the smallest larger side, if that is a real part."""
        best = (0.95 * len(sample), None)
        for pivot in sample[:: max(1, len(sample) // PIVOTS_TRIED)][:PIVOTS_TRIED]:
            up_to = np.cumsum(np.bincount(np.bitwise_count(sample ^ pivot), minlength=65))
            for bound in range(64):
                near = up_to[min(64, bound + self.radius // 2)]
                below = bound - (self.radius - self.radius // 2)
                far = len(sample) - (up_to[below] if below >= 0 else 0)
                best = min(best, (max(near, far), (pivot, bound)), key=lambda x: x[0])
        return best[1]

    def _sides(self, points: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        distance = np.bitwise_count(points ^ self.pivots[at]).astype(np.int64)
        half = self.radius // 2
        return distance <= self.bounds[at] + half, distance > self.bounds[at] - (self.radius - half)

    def shards_of(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each shard with its points; points near a bound go to both sides."""
        todo = [(self.root, points)]
        while todo:
            at, here = todo.pop()
            if at < 0:
                yield -1 - at, here
            elif len(here):
                todo.extend(zip(self.children[at], [here[side] for side in self._sides(here, at)]))


def reach(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Points with company within ``radius``, each with the smallest point it reaches by such steps."""
    rest, members, roots = np.unique(points), [], []
    while len(rest):
        root, rest = rest[:1], rest[1:]
        found, queue = [], [root[0]]
        while queue and len(rest):
            close = np.bitwise_count(rest ^ queue.pop()) <= radius
            if close.any():
                found.extend(rest[close])
                queue.extend(rest[close])
                rest = rest[~close]
        members.extend(found)
        roots.extend([root[0]] * len(found))
    return np.array(members, np.uint64), np.array(roots, np.uint64)


def links(points: DataFrame, radius: int = 2, shard_size: int = SHARD) -> DataFrame:
    """(seed, a, b): enough links between the distinct values ``f`` of each ``seed`` to connect all within ``radius``.

    The wider the radius, the more points lie near a bound and go to both sides, so the larger shards should be.
    """
    distinct = stage(points.select("seed", "f").distinct(), "fingerprints")
    counts = dict(distinct.groupBy("seed").count().collect())  # a few seeds
    count = max(counts.values(), default=0)
    wanted = min(MAX_SAMPLE, SAMPLED_PER_SHARD * (count // shard_size))
    sample = []
    if wanted:
        # bounded: a few dozen fingerprints per shard of thousands, at most about MAX_SAMPLE for each seed
        part = F.pmod(F.xxhash64("f"), F.lit(1 << 40)) < int((1 << 40) * wanted / count)
        sample = distinct.where(part).collect()
    by_seed = {seed: np.array([row.f for row in sample if row.seed == seed], np.int64) for seed in counts}
    trees = {seed: Tree(values.view(np.uint64), radius) for seed, values in by_seed.items()}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = batch.column("seed").to_numpy(zero_copy_only=False)
            values = batch.column("f").to_numpy(zero_copy_only=False).view(np.uint64)
            for seed in np.unique(seeds).tolist():
                for shard, here in trees[seed].shards_of(values[seeds == seed]):
                    if len(here):
                        keys = [pa.array(np.full(len(here), seed, np.int32)), pa.array(np.full(len(here), shard, np.int64))]
                        yield pa.RecordBatch.from_arrays([*keys, pa.array(here.view(np.int64))], ["seed", "shard", "f"])

    def close(group: pa.Table) -> pa.Table:
        members, roots = reach(group.column("f").to_numpy().view(np.uint64), radius)
        seeds = np.full(len(members), group.column("seed")[0].as_py(), np.int32)
        return pa.table({"seed": seeds, "a": members.view(np.int64), "b": roots.view(np.int64)})

    spread = distinct.repartition(max(1, sum(counts.values()) // 16_000), "f")  # a small file would be one task
    dealt = spread.mapInArrow(deal, "seed int, shard bigint, f bigint")
    return dealt.groupBy("seed", "shard").applyInArrow(close, "seed int, a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id reachable."""
    marked = stage(fingerprints(docs, words, (seed,)), "marked")
    roots = components(links(marked.select(F.lit(0).alias("seed"), F.col("f0").alias("f")), radius).select("a", "b"))
    least = marked.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select(F.col("node").alias("f0"), "component_id")
    digits = F.lower(F.lpad(F.hex("f0"), 16, "0"))  # an empty text has fingerprint zero
    return marked.join(classes, "f0").select("doc_id", digits.alias("fingerprint"), "component_id")


#: For documents as similar as ``SIMILARITY`` by shingles of five words: fingerprints of single words, which small edits
#: change little, several of them and at a wider radius, so that hardly a pair is missed before it is compared.
SIMILARITY, SHINGLE, WORD_SEEDS, WORD_RADIUS, ROUNDS = 0.8, 5, (42, 43, 44, 45, 46, 47), 4, 3
#: Orders of the shingles, by which texts that differ by a block meet, whose single words differ too much for the fingerprints.
ORDERS = 16
#: Texts or sets of shingles that Python gets at once.
ROWS_AT_ONCE = 1000
#: Buckets in which shingles are counted over the whole corpus, for their order; set values held at once; pairs for each row of a shingle that are
#: made without a further round; buckets of nodes; allowance for rounding, so that bounds leave out no pair.
COUNTED, SET_VALUES, FEW_PAIRS, NODE_BUCKETS, SLACK = 1 << 21, 1 << 18, 4, 1 << 18, 1e-6


def _blocks(radius: int) -> list[tuple[int, int]]:
    """First bit and width of ``radius + 2`` parts of a fingerprint: two that differ in up to ``radius`` bits agree in two parts at least."""
    edges = [64 * i // (radius + 2) for i in range(radius + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _part(points: np.ndarray, block: tuple[int, int]) -> np.ndarray:
    return (points >> np.uint64(block[0])) & np.uint64((1 << block[1]) - 1)


def company(points: DataFrame, radius: int) -> DataFrame:
    """(seed, f), perhaps repeated: the values ``f`` for which another value of the ``seed`` lies within ``radius``.

    Exact, and each value is sent ``radius + 1`` times however many there are: to one place for each of its parts but the last. Two of the values that
    agree in a part are compared if they agree in a later part too, and as long as one of them has no company yet, so close values in large numbers
    aren't compared pair by pair.
    """
    blocks = _blocks(radius)
    sent = [F.shiftrightunsigned("f", start).bitwiseAND((1 << width) - 1) for start, width in blocks[:-1]]
    places = F.posexplode(F.array(*sent)).alias("turn", "part")
    dealt = points.select("seed", "f").distinct().select("seed", "f", places).repartition("seed", "turn", "part").sortWithinPartitions("seed", "turn", "part")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seed, turn, part, f in _whole_keys(batches, ("seed", "turn", "part", "f")):
            found = _accompanied(np.cumsum(_changes(seed, turn, part)), turn, f.view(np.uint64), blocks, radius)
            yield pa.RecordBatch.from_arrays([pa.array(seed[found]), pa.array(f[found])], ["seed", "f"])

    return dealt.mapInArrow(work, "seed int, f bigint")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column; the first row does not count."""
    changes = np.zeros(len(columns[0]), bool)
    for c in columns:
        changes[1:] |= c[1:] != c[:-1]
    return changes


def _whole_keys(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, some PIECE rows at once, cut where one of all but the last column changes."""
    held, rows = [], 0

    def joined() -> list[np.ndarray]:
        return [np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in names]

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= PIECE:
            columns = joined()
            last = int(np.flatnonzero(_changes(*columns[:-1]))[-1:].sum())  # 0 if there is one key
            if last:
                yield [c[:last] for c in columns]
            held = [pa.RecordBatch.from_arrays([pa.array(c[last:]) for c in columns], list(names))]
            rows = 0 if last else -rows  # of one key as many again are gathered before it is looked at again
    if held:
        yield joined()


def _accompanied(group: np.ndarray, turn: np.ndarray, points: np.ndarray, blocks: list[tuple[int, int]], radius: int) -> np.ndarray:
    """Which points have another one of their group and of a part after ``turn`` within ``radius``."""
    found = np.zeros(len(points), bool)
    for i, block in enumerate(blocks):
        here = np.flatnonzero(turn < i)
        part = _part(points[here], block)
        here = here[np.lexsort((points[here], part, group[here]))]
        part, f = _part(points[here], block), points[here]
        starts = np.flatnonzero(np.concatenate((np.ones(min(1, len(here)), bool), _changes(group[here], part)[1:])))
        sizes = np.diff(np.append(starts, len(here)))
        first, size, near = np.repeat(starts, sizes), np.repeat(sizes, sizes), found[here]
        for step in range(1, FEW_PAIRS + 1):  # neighbours in order, so that most of a crowd has company
            same = np.flatnonzero(first[step:] == first[:-step])
            same = same[np.bitwise_count(f[same] ^ f[same + step]) <= radius]
            near[same], near[same + step] = True, True
        lonely = np.flatnonzero(~near & (size > FEW_PAIRS + 1))
        ends, at = np.cumsum(size[lonely]), 0
        while at < len(lonely):  # each with its whole part, about SET_VALUES pairs at once, or one
            before = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, before + SET_VALUES, side="right")))
            one, many = lonely[at:stop], size[lonely[at:stop]]
            mine = np.repeat(one, many)
            other = np.repeat(first[one], many) + np.arange(len(mine)) - np.repeat(np.cumsum(many) - many, many)
            hit = (np.bitwise_count(f[mine] ^ f[other]) <= radius) & (mine != other)
            near[mine[hit]], near[other[hit]] = True, True
            at = stop
        found[here] = near
    return found


def _close(classes: DataFrame) -> DataFrame:
    """(node): texts with an equal or close fingerprint of any seed."""
    prints = F.array(*[F.struct(F.lit(i).alias("seed"), F.col(f"f{i}").alias("f")) for i in range(len(WORD_SEEDS))])
    stacked = classes.select("node", F.explode(prints).alias("one")).select("node", "one.*")
    several = stacked.groupBy("seed", "f").agg(F.count("*").alias("n")).where("n > 1").select("seed", "f")
    ends = company(stacked, WORD_RADIUS)
    return stacked.join(several.unionByName(ends).distinct(), ["seed", "f"], "left_semi").select("node")


def word_shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of each text in lower case, text by text, and their number; a text of fewer words is one shingle."""
    hashes, count = word_hashes(texts)
    sizes = np.where(count > 0, np.maximum(count - words + 1, 1), 0)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.arange(len(owner)) + np.repeat(np.cumsum(count) - count - (np.cumsum(sizes) - sizes), sizes)
    values, factor = np.zeros(len(owner), np.uint64), 1
    for k in range(words):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        inside = count[owner] > k
        values[inside] += hashes[begin[inside] + k] * np.uint64(factor)
    values = mix(values + np.minimum(count, words)[owner].astype(np.uint64))
    return _distinct_of(values, owner, len(sizes))


def _distinct_of(values: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each owner, owner by owner, and their number."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = _changes(owner, values)
    new[:1] = True
    return values[new], np.bincount(owner[new], minlength=owners)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.view(np.int64)))


def _shingled(texts: DataFrame, words: int) -> DataFrame:
    """The other columns and ``set``, the distinct shingle hashes of ``text``, which is in lower case; none for a text without words."""
    keep = [c for c in texts.columns if c != "text"]
    schema = T.StructType([*[texts.schema[c] for c in keep], T.StructField("set", T.ArrayType(T.LongType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HASHED_BYTES):
            found = _lists(*word_shingles(batch.column("text"), words))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], found], [*keep, "set"])

    return texts.mapInArrow(work, schema)


def _meeting(texts: DataFrame, words: int) -> DataFrame:
    """(node): texts in lower case whose least shingle in one of ORDERS orders is that of another node's text too.

    Whatever makes two sets of shingles differ, a block or scattered words, those that agree to 0.8 miss each other in all 16 orders with a chance of
    0.2**16, one pair in 10**11.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HASHED_BYTES):
            hashes, sizes = word_shingles(batch.column("text"), words)
            if not len(hashes):
                continue
            node, sizes = batch.column("node").filter(pa.array(sizes > 0)), sizes[sizes > 0]
            starts = np.cumsum(sizes) - sizes
            least = [np.minimum.reduceat(mix(hashes + mix(np.full(1, turn + 1, np.uint64))), starts) for turn in range(ORDERS)]
            flat = np.stack(least, axis=1).ravel()
            yield pa.RecordBatch.from_arrays([node, _lists(flat, np.full(len(node), ORDERS))], ["node", "least"])

    schema = T.StructType([texts.schema["node"], T.StructField("least", T.ArrayType(T.LongType()))])
    written = stage(texts.select("node", "text").mapInArrow(work, schema), "least")
    keyed = written.select("node", F.posexplode("least").alias("turn", "h"))
    shared = keyed.groupBy("turn", "h").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low <> high")
    return keyed.join(shared, ["turn", "h"], "left_semi").select("node")


def _buckets(values: np.ndarray) -> np.ndarray:
    return (mix(values.view(np.uint64)) % np.uint64(COUNTED)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many values of a task fall into each bucket, some buckets at once, as the whole table would take several times its size."""
    total = np.zeros(COUNTED, np.uint32)  # a task has fewer values than that holds
    for batch in batches:
        for _, values, _ in _sets(batch):
            np.add.at(total, _buckets(values), 1)  # in place, without another table of COUNTED
    for at in range(0, COUNTED, PIECE):
        part = total[at : at + PIECE]
        seen = np.flatnonzero(part)
        yield pa.RecordBatch.from_arrays([pa.array((seen + at).astype(np.int32)), pa.array(part[seen].astype(np.int64))], ["bucket", "n"])


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many values of all sets fall into each bucket: of one shingle, at least its number of sets.

    A table of fixed size over the whole corpus, summed by Spark. A shingle that many sets have lifts its bucket above those of rare ones.
    """
    summed = sets.mapInArrow(_counts, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most COUNTED rows
    total = np.zeros(COUNTED, np.uint32)
    total[summed.column("bucket").to_numpy()] = np.minimum(summed.column("n").to_numpy(), (1 << 32) - 1)
    return total


def _prefixes(sets: DataFrame, similarity: float, frequencies: Broadcast) -> DataFrame:
    """(shingle, node, size, place): the first shingles of each set, those of rarer buckets before others.

    Two sets that agree to ``similarity`` share one of the first ``n - ceil(similarity * n) + 1`` of each, whatever the order is, as long as
    all sets have the same. With the rarest first, a passage that many texts share is among the first of a set only if it makes up most of it.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, values, sizes in _sets(batch):
                starts, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((values, frequencies.value[_buckets(values)], owner))
                place = np.arange(len(values)) - starts[owner]
                first = sizes - np.ceil(similarity * sizes - SLACK).astype(np.int64) + 1
                kept = place < first[owner]
                rows = [values[order][kept], sizes[owner[kept]].astype(np.int32), place[kept].astype(np.int32)]
                shingle, size, at = (pa.array(x) for x in rows)
                yield pa.RecordBatch.from_arrays([shingle, node.take(pa.array(owner[kept])), size, at], ["shingle", "node", "size", "place"])

    return sets.mapInArrow(work, "shingle bigint, node bigint, size int, place int")


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Nodes, the values of their sets one after the other, and the sizes, about SET_VALUES at once; no empty set."""
    sizes = pc.list_value_length(batch.column("set")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SET_VALUES, side="right")))
        part, here = batch.slice(start, stop - start), sizes[start:stop]
        if here.any():
            yield part.column("node").filter(pa.array(here > 0)), part.column("set").flatten().to_numpy(), here[here > 0]
        start = stop


def _similar(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b): enough of the pairs of ``members`` (node, set) that agree to ``similarity`` to connect all such pairs.

    Every such pair meets at a shingle that both have among their first. Where few meet at a shingle, all pairs there are compared. Where many meet,
    they are compared with one of them, another one in each round, and what still meets there without being connected goes to the
    next round; after the last one, or when there are few, all pairs are compared. So large groups collapse before pairs are made, and no pair is left out.
    """
    sets = members.select("node", "set")
    frequencies = members.sparkSession.sparkContext.broadcast(_frequencies(sets))  # of fixed size
    rows = _prefixes(sets, similarity, frequencies)
    often = rows.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1").select("shingle")
    meeting = stage(rows.join(often, "shingle"), "meeting")
    frequencies.unpersist()
    empty = sets.where(F.size("set") == 0).select(F.col("node").alias("a"))  # alike
    found, roots = [empty.crossJoin(empty.agg(F.min("a").alias("b")))], None
    for turn in range(ROUNDS + 1):
        here = meeting.withColumn("root", F.col("node"))
        if roots is not None:
            here = meeting.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        by_root = here.groupBy("shingle", "root").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", F.lit(turn)), "node", "size", "place")).alias("first"))
        square = F.col("n").cast("double") * F.col("n")
        by_shingle = by_root.groupBy("shingle").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(square).alias("within"), F.min("first").alias("first"))
        few = F.lit(turn == ROUNDS) | ((square - F.col("within")) / 2 <= FEW_PAIRS * F.col("n"))
        unsettled = stage(by_shingle.where("roots > 1").select("shingle", "first", few.alias("few")), "unsettled")
        rest = unsettled.where("not few")
        whole = here.join(unsettled.where("few").select("shingle"), "shingle")
        other = whole.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("node", "size", "place", "root")])
        pairs = whole.join(other, "shingle").where("node < other_node and root <> other_root")
        stars = here.join(rest, "shingle").select("*", *[F.col(f"first.{c}").alias(f"other_{c}") for c in ("node", "size", "place")]).where("node <> other_node")
        columns = ["node", "size", "place", "other_node", "other_size", "other_place"]
        met = pairs.select(*columns).unionByName(stars.select(*columns))
        # a pair that agrees meets at its first common shingle too, with all others of both sets behind it
        shared = F.least(F.col("size") - F.col("place"), F.col("other_size") - F.col("other_place"))
        enough = shared >= similarity * (F.col("size") + F.col("other_size") - shared) - SLACK
        ends = F.least("node", "other_node").alias("a"), F.greatest("node", "other_node").alias("b")
        found.append(stage(_verified(met.where(enough).select(*ends).distinct(), sets, similarity), "alike"))
        if rest.isEmpty():
            break
        roots = components(reduce(DataFrame.unionByName, found))
        meeting = stage(meeting.join(rest.select("shingle"), "shingle"), "meeting")  # at the others all pairs are done
    return reduce(DataFrame.unionByName, found)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    pairs = stage(pairs, "pairs")

    def side(end: str, name: str) -> DataFrame:
        # when few nodes have pairs, most sets needn't be sent: a bounded table of buckets tells which
        bucket = F.pmod(F.xxhash64("node"), F.lit(NODE_BUCKETS)).alias("bucket")
        wanted = pairs.select(F.col(end).alias("node")).select(bucket).distinct()
        chosen = sets.select("*", bucket).join(F.broadcast(wanted), "bucket", "left_semi")
        return chosen.select(F.col("node").alias(end), F.col("set").alias(name))

    shared = F.size(F.array_intersect("mine", "theirs"))
    both = pairs.join(side("a", "mine"), "a").join(side("b", "theirs"), "b")
    return both.where(shared >= similarity * (F.size("mine") + F.size("theirs") - shared)).select("a", "b")


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE) -> DataFrame:
    """The documents but one of each group of equal or similar texts: the one with the smallest id stays.

    Fingerprints, through vantage points, and least shingles find candidates; their sets of shingles decide. Of rows that agree wholly one stays.
    """
    with batches_of(docs.sparkSession, ROWS_AT_ONCE):
        return _distinct(docs, similarity, words)


def _distinct(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    row, digest = fresh(docs, "row_key"), fresh(docs, "text_digest")
    text = F.coalesce("text", F.lit(""))
    digest_of = F.unhex(F.md5(text.cast("binary")))  # different texts never share one, as 64 bits would among billions
    keyed = docs.withColumn(row, F.md5(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).cast("binary")))
    narrow = keyed.select("doc_id", F.col(row).alias("row"), digest_of.alias("digest"), text.alias("text"))
    marked = word_fingerprints(narrow, WORD_SEEDS, ("doc_id", "row", "digest"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    names = [f"f{i}" for i in range(len(WORD_SEEDS))]
    texts = marked.groupBy("digest").agg(F.min(rank).alias("rank"), *[F.first(n).alias(n) for n in names])
    classes = stage(texts.withColumn("node", F.monotonically_increasing_id()), "classes")  # written once, so a number stays
    close = classes.join(_close(classes), "node", "left_semi").select("digest")
    met = _meeting(docs.select(digest_of.alias("node"), F.lower(text).alias("text")), words).select(F.col("node").alias("digest"))
    grouped = classes.join(close.unionByName(met).distinct(), "digest", "left_semi").select("digest", "node", "rank")
    texts = docs.select(text.alias("text"), digest_of.alias(digest))
    wanted = texts.join(grouped.select(F.col("digest").alias(digest)), digest, "left_semi").dropDuplicates([digest])
    sets = _shingled(wanted.select(F.col(digest).alias("digest"), F.lower("text").alias("text")), words)
    members = stage(grouped.join(sets, "digest"), "members")
    groups = components(_similar(members, similarity))
    ranked = members.join(groups.withColumnRenamed("root", "group"), "node").select("node", "group", "rank")
    dropped = ranked.join(ranked.groupBy("group").agg(F.min("rank").alias("least")), "group").where("rank <> least").select("node")
    kept = classes.join(dropped, "node", "left_anti").select(F.col("rank.row").alias(row))
    return keyed.dropDuplicates([row]).join(kept, row, "left_semi").drop(row)
