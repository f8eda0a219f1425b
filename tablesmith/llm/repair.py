"""Repair of the structure of conversations: the cheapest edits, found by Hirschberg's divide and conquer.

Roles should read ``(s?(ua)+)?`` by their initials. A state machine with four states (nothing yet,
after a system, user or assistant turn) says what may follow. Rows may be kept, deleted, given the role user or assistant, and
preceded by empty turns, each at a cost, so a row is a table of four by four costs, from the state before to the state
after it. Rows are put in one order over all conversations and cut into blocks of bounded size. In a block, tables
of neighbours are combined pair by pair up to whole stretches: the row of a table is the forward vector
of four costs, its column the backward one. Then, from the whole down, the forward vector of the first half and the backward vector of
the second meet in the middle; of the crossings of least cost that with the least letters is taken, and both
halves go on by themselves, which takes space linear in the rows. Four ranks beside the costs tell which of the best
ways to a state has the least letters, so no letters are compared. A conversation that crosses blocks is solved in the same way over its
stretches first, in groups of bounded size and as many levels as it takes, so one conversation may hold most of the table.

Defined cases: null roles and texts are one space; turns go by number, null first, then by role and text; rows that repeat
wholly are adjacent; a null conversation id is one conversation; a role is told by its first letter, s, u or a,
and any other, or an empty one, can't be kept; a conversation without rows, and an empty table, have no edits. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import numbered
from tablesmith.session import stage

ROWS_PER_BLOCK = 4096
#: So many stretches of a conversation are solved at once.
FAN = 4096
#: Columns that tell what to do with a row: fixed values of the order of letters, D below I below K below R.
WORDS = ("D", "IK", "IR", "K", "R")
INSERT, DELETE, REROLE, LEFT_TRUNCATED = 5, 2, 1, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or re-roled turn, by the state before, and what ends a conversation.
NEXT = (USER, USER, ASSISTANT, USER)
CLOSING = (0, 2, 1, 0)
INITIALS = "sua"
#: Kinds of rows: whole, truncated, to be deleted.
WHOLE, TRUNCATED, DOOMED = range(3)
NEVER = 1 << 40
BLANK_CHARS = " \t\n\x0b\x0c\r"


def _kept(state: int, initial: int) -> int | None:
    """The state after a row that keeps its role, if it may follow."""
    if initial == 0:
        return SYSTEM if state == START else None
    if initial == 1:
        return USER if state != USER else None
    return ASSISTANT if initial == 2 and state == USER else None


def row_tables() -> np.ndarray:
    """[initial, kind, state before, state after]: cost * 64 + place of the word, for the initials s, u, a and any other."""
    tables = np.full((4, 3, 4, 4), NEVER * 64, np.int64)
    for initial in range(4):
        for kind in range(3):
            for before in range(4):
                ways = [(before, DELETE, 0)]
                if kind != DOOMED:
                    more = LEFT_TRUNCATED if kind == TRUNCATED else 0
                    turned = NEXT[before]
                    ways += [
                        (_kept(turned, initial), INSERT + more, 1), (NEXT[turned], INSERT + REROLE + more, 2),
                        (_kept(before, initial), more, 3), (turned, REROLE + more, 4),
                    ]
                for after, cost, word in ways:
                    if after is not None:
                        tables[initial, kind, before, after] = min(tables[initial, kind, before, after], cost * 64 + word)
    return tables


TABLES = row_tables()


def combined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Tables of two neighbours as one: least cost, then least letters, told by the ranks of both."""
    key = ((first >> 6 << 6) + ((first & 63) << 3))[:, :, :, None] + second[:, None, :, :]
    best = key.min(axis=2)
    cost, order = np.minimum(best >> 6, NEVER), best & 63
    rank = (order[:, :, :, None] > order[:, :, None, :]).sum(axis=3)
    return (cost << 6) + rank


def crossing(first: np.ndarray, second: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The state in the middle, where the forward and backward vectors meet at least cost and with the least letters."""
    at = np.arange(len(first))
    forward, backward = first[at, begin], second[at, :, end]
    return ((((forward >> 6) + (backward >> 6)) << 6) + (forward & 63)).argmin(axis=1)


class Halves:
    """All stretches of a block at once, halved down to single rows: level by level, neighbours of a stretch in pairs."""

    def __init__(self, tables: np.ndarray, stretch: np.ndarray) -> None:
        self.levels = [(tables, stretch)]
        while len(stretch) and (stretch[1:] == stretch[:-1]).any():
            place = np.arange(len(stretch)) - np.searchsorted(stretch, stretch)
            left = np.flatnonzero(place % 2 == 0)
            paired = np.zeros(len(left), bool)
            inside = left + 1 < len(stretch)
            paired[inside] = stretch[left[inside] + 1] == stretch[left[inside]]
            merged = tables[left].copy()
            merged[paired] = combined(tables[left[paired]], tables[left[paired] + 1])
            tables, stretch = merged, stretch[left]
            self.levels.append((tables, stretch))

    @property
    def whole(self) -> np.ndarray:
        """A table per stretch."""
        return self.levels[-1][0]

    def ends(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state before and after each row, from those before and after each stretch."""
        for tables, stretch in reversed(self.levels[:-1]):
            place = np.arange(len(stretch)) - np.searchsorted(stretch, stretch)
            left = np.flatnonzero(place % 2 == 0)
            owner = np.cumsum(place % 2 == 0) - 1
            begins, stops = begin[owner], end[owner]
            right = np.flatnonzero(place % 2 == 1)
            middle = crossing(tables[right - 1], tables[right], begins[right], stops[right])
            stops[right - 1], begins[right] = middle, middle
            begin, end = begins, stops
        return begin, end


def closed(tables: np.ndarray) -> np.ndarray:
    """The state after each stretch from the start on to a good end, of least cost and then least letters."""
    ways = tables[:, START]
    return ((((ways >> 6) + np.array(CLOSING) * INSERT) << 6) + (ways & 63)).argmin(axis=1)


def same_as_before(*columns: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Whether a row equals the one before it, nulls equal."""
    same = None
    for column in columns:
        coded = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values = coded.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        equal = np.concatenate(([False], values[1:] == values[:-1])) if len(values) else np.zeros(0, bool)
        same = equal if same is None else same & equal
    return same


# ---- rows of conversations


def tidy(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with one space for null roles and texts."""
    return turns.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def faults(turns: DataFrame) -> DataFrame:
    """A row per set of equal rows: (at, conv_id, turn, role, text, times, fault), fault null, blank, duplicate or truncated.

    ``at`` is the place in one order over all conversations. The first of ``times`` equal rows has the fault; the
    others are duplicates, or blank as well.
    """
    return _judged(_placed(turns))


def _placed(turns: DataFrame) -> DataFrame:
    rows = tidy(turns).groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    return stage(numbered(rows, order, "at"), "turns")


def _judged(placed: DataFrame) -> DataFrame:
    rest = F.rtrim("text", F.lit(BLANK_CHARS))
    same = F.md5(F.concat_ws("\x00", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.md5("role"), F.md5("text")))
    # the earliest places are unique, so the join by place has no hot key
    first = placed.groupBy(same.alias("same")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("new"))
    fault = F.when(rest == "", "blank").when(F.col("new").isNull(), "duplicate").when(~F.right(rest, F.lit(1)).isin(".", "!", "?"), "truncated")
    return placed.join(first, "at", "left").select(*placed.columns, fault.alias("fault"))


# ---- edits


STATE = "block bigint, conv_id bigint, begin int, end int, follows_bad int"


def edits(turns: DataFrame) -> DataFrame:
    """Rows of :func:`faults` with ``word``, the letters of the first edit of the row, the state ``before`` it, ``closing`` turns
    inserted after it, ``cost`` of all and ``illegal``, how often equal rows or this and the row before may not be neighbours."""
    judged = stage(_judged(_placed(turns)), "judged")
    initial = F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.left("role", F.lit(1))), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(initial)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), DOOMED).when(F.col("fault") == "truncated", TRUNCATED).otherwise(WHOLE)
    light = stage(
        judged.select("at", F.floor(F.col("at") / ROWS_PER_BLOCK).alias("block"), "conv_id", initial.cast("int").alias("initial"), kind.cast("int").alias("kind"), "times"), "steps"
    )
    known = _crossings(light)

    def solve(rows: pa.Table, known: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        initial, tables, stretch = _stretches(rows)
        halves = Halves(tables, stretch)
        count = len(halves.whole)
        begin, end = np.zeros(count, np.int64), closed(halves.whole)
        last = np.ones(count, bool)  # whether the conversation ends with the stretch
        bad_start = np.zeros(count, np.int64)
        heads = np.flatnonzero(np.diff(stretch, prepend=-1))
        named = {c: i for i, c in enumerate(rows.column("conv_id").take(pa.array(heads)).to_pylist())}
        for row in known.to_pylist():  # those that cross the block's bounds
            i = named[row["conv_id"]]
            begin[i], end[i], last[i], bad_start[i] = row["begin"], row["end"], row["ends"], row["follows_bad"]
        before, after = halves.ends(begin, end)
        found = tables[np.arange(len(tables)), before, after]
        times = rows.column("times").to_numpy()
        illegal = (times - 1) + _bad_neighbours(initial, stretch)
        illegal[heads] += bad_start
        closing = np.zeros(len(tables), np.int64)
        tails = np.append(heads[1:], len(tables)) - 1
        closing[tails] = np.where(last, np.array(CLOSING)[end], 0)
        cost = (found >> 6) + DELETE * (times - 1) + INSERT * closing
        words = pa.array(WORDS).take(pa.array(found & 63))
        return pa.table({"at": rows.column("at"), "word": words, "before": pa.array(before), "closing": pa.array(closing), "cost": pa.array(cost), "illegal": pa.array(illegal)})

    schema = "at bigint, word string, before bigint, closing bigint, cost bigint, illegal bigint"
    solved = light.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(solve, schema)
    return judged.join(solved, "at")


def _stretches(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Initials, tables and the number of the stretch of each row of a block."""
    initial = rows.column("initial").to_numpy()
    tables = TABLES[initial, rows.column("kind").to_numpy()]
    stretch = np.cumsum(~same_as_before(rows.column("conv_id"))) - 1
    return initial, tables, stretch


def _bad_neighbours(initial: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """1 for a row that may not stand after the one before it in its stretch."""
    bad = np.zeros(len(initial), np.int64)
    bad[1:] = (stretch[1:] == stretch[:-1]) & ~_may_follow(initial[:-1], initial[1:])
    return bad


def _may_follow(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return ((second == 1) & ((first == 0) | (first == 2))) | ((second == 2) & (first == 1))


CELL = "conv_id bigint, block bigint, cells binary, initials binary"


def _crossings(light: DataFrame) -> DataFrame:
    """(block, conv_id, begin, end, ends, follows_bad) of stretches at the bounds of blocks, whose conversations may go on there."""

    def edges(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        initial, tables, stretch = _stretches(rows)
        chosen = sorted({0, int(stretch[-1])})
        whole = Halves(tables, stretch).whole
        firsts, lasts = np.searchsorted(stretch, chosen), np.searchsorted(stretch, chosen, side="right") - 1
        return pa.table({
            "conv_id": rows.column("conv_id").take(pa.array(firsts)), "block": rows.column("block").slice(0, 1).combine_chunks().take(pa.array([0] * len(chosen))),
            "cells": pa.array([whole[c].tobytes() for c in chosen], pa.binary()), "first": pa.array(initial[firsts]), "last": pa.array(initial[lasts]),
        })

    schema = "conv_id bigint, block bigint, cells binary, first int, last int"
    levels = [stage(light.groupBy("block").applyInArrow(edges, schema).withColumn("place", F.col("block")), "edges")]
    # a conversation's stretches in groups of neighbours, and groups in groups, until a conversation is one group
    while True:
        most = levels[-1].groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= FAN:
            break
        group = F.floor(F.col("place") / FAN).alias("group")
        merged = levels[-1].groupBy("conv_id", group).applyInArrow(_merged, schema.replace("block", "place"))
        levels.append(stage(merged, "groups"))
    solved = stage(levels[-1].groupBy("conv_id").applyInArrow(_solved_top, SOLVED), "solved")
    for level in reversed(levels[:-1]):
        # what is known of a group goes to its members
        members = level.withColumn("group", F.floor(F.col("place") / FAN))
        above = solved.select("conv_id", F.col("place").alias("group"), "begin", "end", "ends", "follows_bad")
        solved = stage(members.groupBy("conv_id", "group").cogroup(above.groupBy("conv_id", "group")).applyInArrow(_solved_group, SOLVED), "solved")
    return solved.withColumnRenamed("place", "block")


SOLVED = "conv_id bigint, place bigint, begin bigint, end bigint, ends boolean, follows_bad bigint"


def _items(group: pa.Table) -> tuple[pa.Table, Halves]:
    group = group.sort_by("place")
    tables = np.stack([np.frombuffer(c, np.int64).reshape(4, 4) for c in group.column("cells").to_pylist()])
    return group, Halves(tables, np.zeros(len(tables), np.int64))


def _merged(key: tuple, group: pa.Table) -> pa.Table:
    group, halves = _items(group)
    return pa.table({
        "conv_id": group.column("conv_id").slice(0, 1), "place": pa.array([key[1].as_py()], pa.int64()), "cells": pa.array([halves.whole[0].tobytes()], pa.binary()),
        "first": group.column("first").slice(0, 1), "last": group.column("last").slice(group.num_rows - 1, 1),
    })


def _solved(group: pa.Table, halves: Halves, begin: int, end: int, ends: bool, follows_bad: int) -> pa.Table:
    before, after = halves.ends(np.array([begin]), np.array([end]))
    first, last = group.column("first").to_numpy(), group.column("last").to_numpy()
    bad = np.append(follows_bad, ~_may_follow(last[:-1], first[1:])).astype(np.int64)
    final = np.zeros(len(before), bool)
    final[-1] = ends
    return pa.table({"conv_id": group.column("conv_id"), "place": group.column("place"), "begin": pa.array(before), "end": pa.array(after), "ends": pa.array(final), "follows_bad": pa.array(bad)})


def _solved_top(group: pa.Table) -> pa.Table:
    group, halves = _items(group)
    return _solved(group, halves, START, int(closed(halves.whole)[0]), True, 0)


def _solved_group(group: pa.Table, above: pa.Table) -> pa.Table:
    group, halves = _items(group)
    known = above.to_pylist()[0]
    return _solved(group, halves, known["begin"], known["end"], known["ends"], known["follows_bad"])


# ---- results


def repaired(edited: DataFrame) -> DataFrame:
    """(conv_id, at, part, edit, role, text): the turns of the repaired conversations, in order of ``at`` and ``part``; inserted ones have an empty text."""
    named = F.create_map(*[F.lit(v) for state, role in ((USER, "user"), (ASSISTANT, "assistant")) for v in (state, role)])
    following = F.create_map(*[F.lit(v) for pair in enumerate(NEXT) for v in pair])

    def turn(part: int, edit: str, role: Column, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), F.lit(edit).alias("edit"), role.alias("role"), text.alias("text"))

    once = following[F.col("before").cast("int")]
    twice = following[once]
    word, empty = F.col("word"), F.lit("")
    own = F.when(word.endswith("K"), turn(1, "K", F.col("role"), F.col("text"))).when(
        word.endswith("R"), turn(1, "R", F.when(word == "R", named[once]).otherwise(named[twice]), F.col("text"))
    )
    # two turns close after a system turn, else the assistant's is what lacks
    parts = F.array(
        F.when(word.startswith("I"), turn(0, "I", named[once], empty)), own,
        F.when(F.col("closing") == 2, turn(2, "I", F.lit("user"), empty)), F.when(F.col("closing") > 0, turn(3, "I", F.lit("assistant"), empty)),
    )
    return edited.select("conv_id", "at", F.inline(F.filter(parts, lambda p: p.isNotNull())))


def audits(edited: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256): letters and a digest of the repaired turns, ``role:text`` by lines, of each conversation with rows.

    Rows pass in order through a task that holds one running digest, never a conversation.
    """
    letters = edited.select(
        "conv_id", "at", F.lit(-1).alias("part"), F.concat("word", F.repeat(F.lit("D"), (F.col("times") - 1).cast("int")), F.repeat(F.lit("I"), F.col("closing").cast("int"))).alias("letters"),
        F.lit(None).cast("string").alias("line"),
    )
    lines = repaired(edited).select("conv_id", "at", "part", F.lit("").alias("letters"), F.concat("role", F.lit(":"), "text").alias("line"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, digest, held, opened, done = None, hashlib.sha256(), [], False, []
        started = False

        def result() -> pa.RecordBatch:
            ids, words, digests = zip(*done)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string()), pa.array(digests, pa.string())], ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for conv, letter, line in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "letters", "line"))):
                if not started or conv != owner:
                    if started:
                        done.append((owner, "".join(held), digest.hexdigest()))
                    owner, digest, held, opened, started = conv, hashlib.sha256(), [], False, True
                if line is None:
                    held.append(letter)
                else:
                    digest.update((b"\n" if opened else b"") + line.encode())
                    opened = True
            if done:
                yield result()
                done = []
        if started:
            done.append((owner, "".join(held), digest.hexdigest()))
            yield result()

    ordered = letters.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "at", "part")
    return ordered.mapInArrow(work, "conv_id bigint, audit string, repaired_sha256 string")


def report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per conversation of ``original``: gaps, faults, illegal neighbours, the cost and letters of the edits of ``turns`` and a digest of the result."""
    edited = stage(edits(turns), "edits")
    turn_sums = edited.groupBy("conv_id", "turn").agg(
        *[F.sum(F.when(F.col("fault") == f, F.when(F.lit(f == "blank"), F.col("times")).otherwise(1)).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.sum(F.when(F.coalesce(F.col("fault"), F.lit("")) != "blank", F.col("times") - 1).otherwise(0)).alias("more"),
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
    )
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    sums = turn_sums.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"), F.sum("blank").alias("blank"), (F.sum("duplicate") + F.sum("more")).alias("duplicate"),
        F.sum("truncated").alias("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
    )
    every = original.select("conv_id").distinct()
    found = sums.join(audits(edited).withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    both = every.join(found.withColumnRenamed("conv_id", "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )


# ---- damage


def damaged(turns: DataFrame) -> DataFrame:
    """Rows with faults planted by a digest of conversation and turn: dropped, emptied, without ends, repeated, or with the role user."""
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id",)], F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = tidy(turns).withColumn("fate", F.crc32(key.cast("binary")) % 20)
    copies = F.explode(F.when(F.col("fate") == 0, F.array().cast("array<int>")).when(F.col("fate") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies).drop("copy")
