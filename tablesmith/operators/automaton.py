"""Many patterns in one walk: which of thousands of texts occur in each row.

The patterns become one table of steps (a trie whose failed steps are filled in, so that each character is one look-up), in
which a state also names the pattern that ends there and the next shorter one. The table is broadcast; its
size is checked, and patterns that would exceed it go to several tables, each walked over the rows in turn. The plan is the same for ten
patterns and for a million. In a task the characters of some megabytes of rows are walked in thousands of lanes at once,
each lane beginning as many characters early as the longest pattern has.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of a table, four bytes each.
MOST_CELLS = 1 << 24
LANES, SLICE_CHARS = 4096, 1 << 22


class Automaton:
    """Steps over characters: ``steps[state, kind]``, ``ends[state]`` a pattern or -1, ``shorter[state]`` the next state that ends one, or 0."""

    def __init__(self, patterns: Sequence[str]) -> None:
        self.longest = max(map(len, patterns), default=1)
        alphabet = sorted({c for p in patterns for c in p})
        self.kinds = np.zeros(0x110000, np.int32)  # 0 for characters of no pattern
        self.kinds[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for number, pattern in enumerate(patterns):
            state = 0
            for character in pattern:
                kind = int(self.kinds[ord(character)])
                if kind not in children[state]:
                    children[state][kind] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][kind]
            ends[state] = number
        self.ends = np.array(ends, np.int64)
        self.steps = np.zeros((len(children), len(alphabet) + 1), np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        fail = np.zeros(len(children), np.int32)
        front = [0]
        while front:  # by depth, so that shorter suffixes are filled in before
            following = []
            for state in front:
                if state:
                    self.steps[state] = self.steps[fail[state]]
                for kind, child in children[state].items():
                    fail[child] = self.steps[fail[state], kind] if state else 0
                    self.shorter[child] = fail[child] if ends[fail[child]] >= 0 else self.shorter[fail[child]]
                    self.steps[state, kind] = child
                    following.append(child)
            front = following

    def found(self, points: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last character, pattern) of all occurrences that no edge between rows cuts; an edge is a place that no pattern may hold."""
        kinds = self.kinds[points]
        kinds[edges] = 0
        width = min(LANES, max(1, len(kinds)))
        length = -(-len(kinds) // width)
        starts = np.arange(width) * length
        state, warm = np.zeros(width, np.int32), self.longest - 1
        # characters before the first and after the last are of no pattern
        padded = np.concatenate((np.zeros(warm, np.int32), kinds, np.zeros(width * length - len(kinds), np.int32)))
        places, states = [], []
        marked = (self.ends >= 0) | (self.shorter > 0)
        for step in range(warm + length):
            state = self.steps[state, padded[starts + step]]
            if step >= warm:
                hit = np.flatnonzero(marked[state])
                if len(hit):
                    places.append(starts[hit] + step - warm)
                    states.append(state[hit])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place, at = np.concatenate(places), np.concatenate(states)
        out_place, out_pattern = [], []
        while len(at):  # the pattern that ends here, then the shorter ones
            here = self.ends[at] >= 0
            out_place.append(place[here])
            out_pattern.append(self.ends[at[here]])
            place, at = place[self.shorter[at] > 0], self.shorter[at[self.shorter[at] > 0]]
        return np.concatenate(out_place), np.concatenate(out_pattern)


def _spaces() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[c for c in range(0x3001) if chr(c).isspace()]] = True
    return out


def tables(patterns: Sequence[str], most_cells: int = MOST_CELLS) -> Iterator[list[str]]:
    """Patterns in lists whose tables stay within the bound; neighbours in order share beginnings."""
    held, cells, letters = [], 0, set()
    for pattern in sorted(patterns):
        more = letters | set(pattern)
        if held and (cells + len(pattern) + 1) * (len(more) + 1) > most_cells:
            yield held
            held, cells, more = [], 0, set(pattern)
        held.append(pattern)
        cells, letters = cells + len(pattern), more
    if held:
        yield held


def occurrences(rows: DataFrame, text: str, patterns: Sequence[str], keep: Sequence[str], most_cells: int = MOST_CELLS) -> DataFrame:
    """(keep, pattern, times, whole): each pattern that occurs in a text, how often, and whether once with blanks or ends on both sides.

    Characters are compared as they are. Empty patterns and null texts have no occurrences; occurrences may overlap. ``keep`` should tell rows apart.
    """
    wanted = sorted({p for p in patterns if p})
    source = rows.select(*keep, F.col(text).alias("_text"))
    schema = source.select(*keep, F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("times"), F.lit(True).alias("whole")).schema
    context = rows.sparkSession.sparkContext

    def walked(part: list[str]) -> DataFrame:
        shared = context.broadcast(Automaton(part))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spaces, names = _spaces(), pa.array(part)
            for batch in batches:
                lengths = pc.fill_null(pc.utf8_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(lengths + 1)
                start = 0
                while start < batch.num_rows:
                    before = ends[start - 1] if start else 0
                    stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
                    yield from _hits(batch.slice(start, stop - start), ends[start:stop] - before, shared.value, part, names, spaces)
                    start = stop

        return source.mapInArrow(work, schema)

    parts = [walked(part) for part in tables(wanted, most_cells)]
    return reduce(DataFrame.unionByName, parts) if parts else source.select(*keep, F.lit("").alias("pattern"), F.lit(0).cast("bigint").alias("times"), F.lit(True).alias("whole")).where("false")


def _hits(batch: pa.RecordBatch, ends: np.ndarray, automaton: Automaton, part: list[str], names: pa.Array, spaces: np.ndarray) -> Iterator[pa.RecordBatch]:
    texts = batch.column("_text").to_pylist()
    points = np.frombuffer("".join(f"{t or ''}\n" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = ends - 1
    place, pattern = automaton.found(points, edges)
    if not len(place):
        return
    blank = spaces[points]
    blank[edges] = True
    sizes = np.array([len(p) for p in part])[pattern]
    first = place - sizes
    whole = blank[place + 1] & ((first < 0) | blank[np.maximum(first, 0)])
    row = np.searchsorted(edges, place, side="left")
    keys, at = np.unique(row * len(part) + pattern, return_inverse=True)
    times = np.bincount(at)
    any_whole = np.bincount(at, weights=whole) > 0
    rows = pa.array(keys // len(part))
    columns = [batch.column(i).take(rows) for i in range(batch.num_columns - 1)]
    columns += [names.take(pa.array(keys % len(part))), pa.array(times), pa.array(any_whole)]
    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "pattern", "times", "whole"])
