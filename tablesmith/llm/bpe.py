"""Byte-level BPE with the ranks of a public vocabulary: texts to ids and back.

Tasks cut texts into pieces by the vocabulary's pattern and gather two megabytes of texts
into one row with their distinct pieces. Each row is joined with the one row of a broadcast table that
holds what pairs of ids merge to. Tasks then fold the ranked merges over the bytes of each distinct piece, those of about the same
length side by side: a step joins in each piece the leftmost pair of the lowest rank and looks the two new pairs up,
for all pieces at once. Then the ids of the pieces are put together again. Texts aren't shuffled, and nothing of them is collected.
Pieces given as common are folded once beforehand and sent to all tasks; which these are changes no result.
Decoding concatenates the bytes of the ids.

A step takes time for the whole length, so pieces of more than ``LONG`` bytes, such as long runs of
blanks, take the same merges from a heap.

Defined cases: a null text is an empty one, without ids; rows that repeat keep their own result; null ids stay
null; an empty table gives an empty result. Texts that look like special tokens are
ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablesmith.llm.common import fresh, slices
from tablesmith.session import stage

LONG = 128
#: Pieces are folded beside others of up to the same of these lengths, so many bytes at once.
WIDTHS, FOLDED_BYTES = np.array([2, 4, 6, 8, 10, 12, 16, 24, 32, 48, 64, 96, LONG]), 1 << 18
#: Where the rank begins in the number that stands for a pair, after the place; the rank of pairs that don't merge.
RANK_AT, NONE = 7, 1 << 40
#: Texts are cut two megabytes at a time, which takes some 20 bytes for each, and chunks put together so many at once.
BATCH_BYTES, CHUNKS_AT_ONCE = 2 << 20, 1 << 17
#: A blank of any kind; no less than in patterns.
BLANK = r"[\s\v\x1c-\x1f\x{85}\p{Z}]"
#: Common pieces, at most, and the documents that they are counted in, about.
COMMON, SAMPLE_DOCS = 1 << 18, 20_000
#: Rows that these are dealt to.
COMMON_ROWS = 64
IDS = np.dtype("<u4")
#: What a row has of its texts: chunks of each text, their numbers, pieces of each chunk, their codes, lengths and bytes of new pieces.
PARTS = ["sizes", "numbers", "lengths", "codes", "new", "bytes"]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 piece and its rank on each line. The driver reads it; tasks get it with the job."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def rank_table(spark: SparkSession, ranks: dict[bytes, int]) -> DataFrame:
    """(ranks): :func:`packed_ranks` in one row, written and read again, so that they aren't a literal in plans."""
    return stage(spark.createDataFrame([(bytearray(packed_ranks(ranks)),)], "ranks binary").coalesce(1), "ranks")


def packed_ranks(ranks: dict[bytes, int]) -> bytes:
    """The ids of single bytes, then what pairs of ids merge to: the pairs, each as one number, and the ranks; compressed, as each row carries them."""
    pairs = [
        (ranks[piece[:cut]] << 32 | ranks[piece[cut:]], rank) for piece, rank in ranks.items() for cut in range(1, len(piece)) if piece[:cut] in ranks and piece[cut:] in ranks
    ]
    single = [ranks[bytes([b])] for b in range(256)]
    return zlib.compress(np.concatenate((np.array(single, np.int64), np.array(sorted(pairs), np.int64).reshape(-1, 2).T.ravel())).tobytes())


class Merges:
    """What pairs of neighbouring ids merge to, in a table with open addresses, a quarter of them taken at most."""

    def __init__(self, packed: bytes) -> None:
        numbers = np.frombuffer(zlib.decompress(packed), np.int64)
        self.single, (pairs, ranks) = numbers[:256], numbers[256:].reshape(2, -1)
        bits = max(1, (4 * len(pairs)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.pairs, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        todo, at = np.arange(len(pairs)), self._address(pairs)
        while len(todo):
            here = at[todo]
            free = self.pairs[here] < 0
            self.pairs[here[free]] = pairs[todo[free]]
            mine = self.pairs[here] == pairs[todo]
            self.ranks[here[mine]] = ranks[todo[mine]]
            todo = todo[~mine]
            at[todo] = at[todo] + 1 & self.last
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256))

    def _address(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, which is the id that it merges to."""
        pairs = left << 32 | right
        at = self._address(pairs)
        seen, found = self.pairs[at], self.ranks[at]
        rest = np.flatnonzero((seen != pairs) & (seen >= 0))
        while len(rest):  # the next address, until there is the pair or nothing
            at[rest] = at[rest] + 1 & self.last
            seen, found[rest] = self.pairs[at[rest]], self.ranks[at[rest]]
            rest = rest[(seen != pairs[rest]) & (seen >= 0)]
        return found

    def fold(self, lengths: np.ndarray, flat: np.ndarray) -> Ragged:
        """The ids of pieces of at most ``LONG`` bytes, end to end as ``flat``, by folds of ranked merges."""
        starts, order, sizes, ids = np.cumsum(lengths) - lengths, [np.flatnonzero(lengths == 0)], [], []
        sizes.append(np.zeros(len(order[0]), np.int64))
        group = np.where(lengths > 0, np.searchsorted(WIDTHS, lengths), -1)
        for at, width in enumerate(WIDTHS.tolist()):
            members = np.flatnonzero(group == at)
            for some in np.array_split(members, -(-len(members) * width // FOLDED_BYTES)) if len(members) else []:
                folded = self._folded(flat, starts[some], lengths[some], width)
                order.append(some)
                sizes.append(folded.lengths)
                ids.append(folded.flat)
        places = np.empty(len(lengths), np.int64)
        places[np.concatenate(order)] = np.arange(len(lengths))
        sizes = np.concatenate(sizes)
        return Ragged(sizes[places], Ragged(sizes, np.concatenate([np.zeros(0, IDS), *ids])).taken(places))

    def _folded(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> Ragged:
        """A column for each piece, a row for each place in it. A part is named by the place where it begins; of the numbers
        in ``state``, rank and place of a part with its right neighbour, the least of a column is the leftmost pair of the lowest rank."""
        n, places = len(starts), np.arange(width)[:, None]
        inside = places < lengths
        values = flat[np.where(inside, starts + places, starts)].astype(np.int64)
        ids = self.single[values]
        after = np.where(places + 1 < lengths, places + 1, width)
        before = np.broadcast_to(places - 1, (width, n)).copy()
        state = np.full((width, n), NONE << RANK_AT)
        np.copyto(state[:-1], (self.of_bytes[values[:-1] << 8 | values[1:]] << RANK_AT) + places[:-1], where=inside[1:])
        columns = np.arange(n)
        while True:
            best = state.min(axis=0)
            live = best < NONE << RANK_AT
            if not live.all():
                state, columns, best = state[:, live], columns[live], best[live]
            if not len(columns):
                break
            at, new, here = best & LONG - 1, best >> RANK_AT, np.arange(len(columns))
            gone = after[at, columns]
            right = after[gone, columns]
            ids[at, columns], after[at, columns], inside[gone, columns] = new, right, False
            state[gone, here], state[at, here] = NONE << RANK_AT, NONE << RANK_AT
            r, l = np.flatnonzero(right < width), np.flatnonzero(at)
            before[right[r], columns[r]] = at[r]
            left = before[at[l], columns[l]]
            ranks = self.rank(np.concatenate((new[r], ids[left, columns[l]])), np.concatenate((ids[right[r], columns[r]], new[l])))
            state[at[r], r], state[left, l] = (ranks[: len(r)] << RANK_AT) + at[r], (ranks[len(r) :] << RANK_AT) + left
        return Ragged(inside.sum(axis=0), ids.T[inside.T].astype(IDS))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece of any length: the same merges, from a heap of ranks."""
    ends = list(range(1, len(piece) + 1))  # by where a part starts; 0 where none does any more
    before = list(range(-1, len(piece) - 1))
    heap: list[tuple[int, int, int]] = []

    def push(at: int) -> None:
        middle = ends[at] if at >= 0 else len(piece)
        if middle < len(piece):
            rank = ranks.get(piece[at : ends[middle]])
            if rank is not None:
                heapq.heappush(heap, (rank, at, ends[middle]))

    for at in range(len(piece)):
        push(at)
    while heap:
        rank, at, end = heapq.heappop(heap)
        middle = ends[at]
        if not middle or middle >= len(piece) or ends[middle] != end or ranks.get(piece[at:end]) != rank:
            continue
        ends[at], ends[middle] = end, 0
        if end < len(piece):
            before[end] = at
        push(at)
        if at > 0:
            push(before[at])
    out, at = [], 0
    while at < len(piece):
        out.append(ranks[piece[at : ends[at]]])
        at = ends[at]
    return out


class Codec:
    """A vocabulary with its pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern

    def cut(self, batches: Iterator[pa.RecordBatch], known: pa.Array, keep: list[str]) -> Iterator[pa.RecordBatch]:
        """One row per two megabytes of texts: kept columns, numbers of chunks, pieces of each chunk, bytes of the new pieces.

        A single blank before a chunk belongs to it, so no piece reaches over from one chunk to the next, and each
        distinct chunk is cut into pieces once. Where a blank of any kind stands before one that doesn't hold, and
        the pieces themselves are the chunks. Codes of pieces from 0 are places in the known
        pieces, codes below are ``-1 -`` places in the new ones.
        """
        find = regex.compile(self.pattern).findall
        for batch in slices(batches, size=BATCH_BYTES):
            sizes, chunks, after_blank = _chunks(pc.fill_null(batch.column("text"), ""), find)
            chunks = chunks.dictionary_encode()
            keys = chunks.indices.to_numpy().astype(np.int64) * 2 + after_blank
            used = np.zeros(2 * len(chunks.dictionary), bool)
            used[keys] = True
            order, lengths, pieces = _pieces(chunks.dictionary, np.flatnonzero(used), find)
            places = np.empty(len(used), np.int32)
            places[order] = np.arange(len(order))
            numbers = places[keys]
            del chunks, keys, used
            pieces = pieces.dictionary_encode()
            places = pc.index_in(pieces.dictionary, value_set=known)
            new = pieces.dictionary.filter(places.is_null())
            codes = np.empty(len(places), np.int32)
            seen = places.is_valid().to_numpy(zero_copy_only=False)
            codes[seen], codes[~seen] = places.drop_null().to_numpy(), ~np.arange(len(new))
            ends, data = _strings(new)
            parts = [*[np.array(x, np.int32) for x in (sizes, numbers, lengths, codes[pieces.indices.to_numpy()], np.diff(ends))], data]
            runs = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in parts]
            packed = [_packed([x]) for x in (batch.select(keep), pa.RecordBatch.from_arrays(runs, PARTS))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in packed], ["kept", "parts"])

    def put(self, batches: Iterator[pa.RecordBatch], known: Ragged) -> Iterator[tuple[pa.RecordBatch, Ragged]]:
        """The kept columns and the ids of each text."""
        merges = None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(n)[row].as_buffer() for n in batch.schema.names}
                merges = merges or Merges(one["ranks"])  # the same in all rows
                sizes, numbers, lengths, codes, new, data = (x.values.to_numpy() for x in _unpacked(one["parts"]).columns)
                new = self._ids(merges, new, data)
                # new pieces come first, so that ~code and count + code are places in one table
                pieces = Ragged(np.concatenate((new.lengths, known.lengths)), np.concatenate((new.flat, known.flat)))
                places = np.where(codes < 0, ~codes, len(new.lengths) + codes)
                chunks = Ragged(np.add.reduceat(np.append(pieces.lengths[places], 0), np.cumsum(lengths) - lengths) * (lengths > 0), pieces.taken(places)) if len(lengths) else Ragged(lengths, codes)
                ends = np.cumsum(sizes)
                kept, at = _unpacked(one["kept"]), 0
                while at < len(sizes):  # some texts at once
                    stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNKS_AT_ONCE, side="right")))
                    mine = numbers[ends[at] - sizes[at] : ends[stop - 1]]
                    yield kept.slice(at, stop - at), Ragged(sizes[at:stop], chunks.lengths[mine]).sums(chunks.taken(mine))
                    at = stop

    def _ids(self, merges: Merges, lengths: np.ndarray, data: np.ndarray) -> Ragged:
        """The ids of pieces of any length."""
        long = np.flatnonzero(lengths > LONG)
        if not len(long):
            return merges.fold(lengths, data)
        ends, short = np.cumsum(lengths, dtype=np.int64), lengths <= LONG
        folded = merges.fold(np.where(short, lengths, 0), data[np.repeat(short, lengths)])
        parts, sizes = np.split(folded.flat, np.cumsum(folded.lengths)[long]), folded.lengths.copy()
        apart = [np.array(merge(data[ends[i] - lengths[i] : ends[i]].tobytes(), self.ranks), IDS) for i in long]
        sizes[long] = [len(x) for x in apart]
        return Ragged(sizes, np.concatenate([*chain.from_iterable(zip(parts, apart)), parts[-1]]))

    def decoder(self) -> Callable[[Ragged], Ragged]:
        """From the ids of texts to their bytes."""
        words = [b""] * (max(self.ranks.values()) + 1)
        for piece, rank in self.ranks.items():
            words[rank] = piece
        table = Ragged(np.array(list(map(len, words)), np.int64), np.frombuffer(b"".join(words), np.uint8))
        return lambda texts: Ragged(texts.lengths, table.lengths[texts.flat]).sums(table.taken(texts.flat))


@dataclass(frozen=True)
class Ragged:
    """Runs of values, end to end."""

    lengths: np.ndarray
    flat: np.ndarray

    def sums(self, flat: np.ndarray) -> Ragged:
        """Runs of ``flat``, each as long as the values of a run here are in sum."""
        ends = np.concatenate(([0], np.cumsum(self.flat)))[np.concatenate(([0], np.cumsum(self.lengths)))]
        return Ragged(np.diff(ends), flat)

    def binary(self) -> pa.Array:
        """Each run's bytes."""
        ends = np.concatenate(([0], np.cumsum(self.lengths))) * self.flat.itemsize
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.lengths), [None, pa.py_buffer(ends), pa.py_buffer(self.flat)]).cast(pa.binary())

    def taken(self, places: np.ndarray) -> np.ndarray:
        """The values of the runs at ``places``, end to end."""
        starts, lengths = (np.cumsum(self.lengths) - self.lengths)[places], self.lengths[places]
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)]


def _chunks(texts: pa.Array, find: Callable[[str], list[str]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How many chunks each text has, the chunks, and whether a blank stands before each."""
    plain = pc.match_substring_regex(texts, f"{BLANK} ")
    lists = pc.split_pattern(texts.filter(pc.invert(plain)), " ")
    apart = plain.to_numpy(zero_copy_only=False)
    if apart.any():
        found = pa.array([find(t) for t in texts.filter(plain).to_pylist()], lists.type)
        lists = pa.concat_arrays([lists, found]).take(pa.array(np.argsort(np.concatenate((np.flatnonzero(~apart), np.flatnonzero(apart))))))
    sizes, chunks = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten()
    after_blank = np.repeat(~apart, sizes)
    after_blank[(np.cumsum(sizes) - sizes)[sizes > 0]] = False
    return sizes, chunks, after_blank


def _pieces(chunks: pa.Array, keys: np.ndarray, find: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The keys in another order, how many pieces each has, and the pieces. A key is twice the place of a chunk, and one more with a blank before it.

    Chunks after a blank are searched as one text, in which the next piece that begins with a blank begins the next
    chunk. Those that end with a blank, which might go together with the next one's, are searched by themselves.
    """
    texts = chunks.to_numpy(zero_copy_only=False).tolist()
    joined = (keys % 2 == 1) & ~pc.match_substring_regex(chunks, f"(^|{BLANK})$").to_numpy(zero_copy_only=False)[keys // 2]
    found = pa.array(find("".join([" " + texts[k] for k in (keys[joined] // 2).tolist()])), pa.string())
    begins = np.flatnonzero(pc.starts_with(found, " ").to_numpy(zero_copy_only=False))
    if len(begins) != joined.sum():  # a pattern that leaves out blanks
        joined[:], begins, found = False, begins[:0], found[:0]
    apart = [find(" " + texts[k >> 1] if k & 1 else texts[k >> 1]) for k in keys[~joined].tolist()]
    lengths = np.concatenate((np.diff(np.append(begins, len(found))), np.array(list(map(len, apart)), np.int64)))
    return np.concatenate((keys[joined], keys[~joined])), lengths, pa.concat_arrays([found, pa.array(chain.from_iterable(apart), pa.string())])


def _strings(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the strings begin and the last one ends, and their bytes."""
    if not len(strings):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1]
    return ends - ends[0], np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]


def _packed(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return next(iter(table.to_batches()), pa.RecordBatch.from_pylist([], table.schema))


def common_pieces(docs: DataFrame, codec: Codec, documents: int = SAMPLE_DOCS, most: int = COMMON) -> DataFrame:
    """(piece): at most ``most`` pieces, the most frequent of about ``documents`` documents. They save work only: others are folded where they occur."""
    share = min(1.0, documents / max(1, docs.count()))
    chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, total = regex.compile(codec.pattern).findall, Counter()
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                total.update(find(text or ""))
        seen = [(p, n) for p, n in total.items() if len(p) <= LONG // 4]  # no longer than LONG in bytes
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.string()), pa.array([n for _, n in seen], pa.int64())], ["piece", "n"])

    counts = chosen.select("text").mapInArrow(count, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    counts = stage(counts, "pieces")
    least, room = 1, most
    for n, pieces in sorted(counts.groupBy("n").count().collect(), reverse=True):  # one row per frequency, few
        room -= pieces
        if room < 0:
            least = n + 1
            break
    return counts.where(F.col("n") >= least).select("piece")


def encoded(docs: DataFrame, codec: Codec, keep: list[str] | None = None, common: DataFrame | None = None, decoding: bool = False) -> DataFrame:
    """The kept columns, all if not said, and ``ids``: each text's ids as little-endian unsigned 32-bit integers.

    With ``decoding`` also ``bytes``, what the ids decode to, without another pass.
    ``common`` (piece), such as :func:`common_pieces` gives, is folded beforehand.
    """
    keep = docs.columns if keep is None else keep
    spark, names = docs.sparkSession, [fresh(docs, n) for n in (("ids", "bytes") if decoding else ("ids",))]
    table = F.broadcast(rank_table(spark, codec.ranks))
    # at most as many pieces as are given, as a few buffers on the driver
    folded = [] if common is None else folds(common, table).toArrow().to_batches()
    columns = [pa.concat_arrays([pa.array([], kind), *[b.column(i) for b in folded]]) for i, kind in enumerate((pa.string(), pa.binary()))]
    known = spark.sparkContext.broadcast(_packed([pa.RecordBatch.from_arrays(columns, ["piece", "ids"])]))
    del folded, columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return codec.cut(batches, _unpacked(known.value).column("piece"), keep)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, (ends, flat) = codec.decoder(), _strings(_unpacked(known.value).column("ids"))
        for kept, ids in codec.put(batches, Ragged(np.diff(ends) // IDS.itemsize, flat.view(IDS))):
            columns = [*kept.columns, ids.binary()]
            if decoding:
                columns.append(decode(ids).binary())
            yield pa.RecordBatch.from_arrays(columns, [*kept.schema.names, *names])

    needed = [*keep, *([] if "text" in keep else ["text"])]
    pieces = docs.select(*needed).mapInArrow(cut, "kept binary, parts binary")
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(n, T.BinaryType()) for n in names]])
    return pieces.crossJoin(table).mapInArrow(put, schema)


def folds(pieces: DataFrame, table: DataFrame) -> DataFrame:
    """(piece, ids) of pieces of at most ``LONG`` bytes, each once, thousands in a row, as each row is joined with the whole table."""
    few = pieces.where(F.octet_length("piece") <= LONG).distinct()
    rows = few.groupBy(F.pmod(F.xxhash64("piece"), F.lit(COMMON_ROWS)).alias("row")).agg(F.collect_list("piece").alias("pieces"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = None
        for batch in batches:
            for row in range(batch.num_rows):
                merges = merges or Merges(batch.column("ranks")[row].as_buffer())
                here = batch.column("pieces")[row].values
                ends, data = _strings(here)
                yield pa.RecordBatch.from_arrays([here, merges.fold(np.diff(ends), data).binary()], ["piece", "ids"])

    return rows.select("pieces").crossJoin(table).mapInArrow(work, "piece string, ids binary")


def decoded(tokens: DataFrame, codec: Codec) -> DataFrame:
    """The rows with ``bytes``: what the ids stand for, put together."""
    name = fresh(tokens, "bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec.decoder()
        for batch in slices(batches, "ids"):
            ends, flat = _strings(pc.fill_null(batch.column("ids"), b""))
            whole = decode(Ragged(np.diff(ends) // IDS.itemsize, flat.view(IDS)))
            yield pa.RecordBatch.from_arrays([*batch.columns, whole.binary()], [*batch.schema.names, name])

    return tokens.mapInArrow(work, T.StructType([*tokens.schema.fields, T.StructField(name, T.BinaryType())]))


def digests(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text."""
    return encoded(docs.select("doc_id", "text"), codec, ["doc_id"], decoding=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
