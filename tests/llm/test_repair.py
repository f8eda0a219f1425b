"""Repair of conversations against a plain search over all edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from samples import SF_DIR
from pyspark.sql import functions as F

from tablesmith.llm import queries, repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NOT_BLANK = re.compile(r"[^\x20\x09-\x0D]")
FOLLOWS = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
ADDED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def plain_report(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation, from every way to edit it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    seen, kinds = set(), []
    for _, role, text in rows:
        shown = NOT_BLANK.findall(text)
        kinds.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))

    def inserted(states: dict) -> dict:
        for _ in range(4):
            for state, (cost, audit, lines) in list(states.items()):
                added = ADDED[state]
                way = (cost + 5, audit + "I", lines + [NAMES[added] + ":"])
                states[added] = min(states.get(added, way), way, key=lambda w: w[:2])
        return states

    # the empty audit, then each row in turn: by state the cheapest way, of those the least letters
    states = inserted({"": (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds):
        after: dict = {}
        for state, (cost, audit, lines) in states.items():
            ways = [(state, (cost + 2, audit + "D", lines))]
            if kind not in ("blank", "duplicate"):
                more = 5 * (kind == "truncated")
                if FOLLOWS[state].get(role[:1]):
                    ways.append((FOLLOWS[state][role[:1]], (cost + more, audit + "K", lines + [f"{role}:{text}"])))
                ways.append((ADDED[state], (cost + 1 + more, audit + "R", lines + [f"{NAMES[ADDED[state]]}:{text}"])))
            for to, way in ways:
                after[to] = min(after.get(to, way), way, key=lambda w: w[:2])
        states = inserted(after)
    cost, audit, lines = min((states[s] for s in ("", "a") if s in states), key=lambda w: w[:2])
    digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, digest


def plain_reports(original: list[tuple], rows: list[tuple]) -> dict:
    groups: dict = {conv: [] for conv, *_ in original}
    for conv, *rest in rows:
        groups[conv].append(tuple(rest))
    return {conv: plain_report(group) for conv, group in groups.items()}


def check(result, original: list[tuple], rows: list[tuple]) -> None:
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in result.collect()}
    assert got == plain_reports(original, rows)


def made(rng: random.Random, conv: int | None, length: int) -> list[tuple]:
    roles = ["user", "assistant", "system", "tool", "User", "", None, "under"]
    texts = ["Yes.", "No", "Why?", "", " \t", None, "Oh!  ", "Long words here. And more", "日本語。", "é."]
    out = []
    for i in range(length):
        role = ("user", "assistant")[i % 2] if rng.random() < 0.7 else rng.choice(roles)
        text = f"{i}." if rng.random() < 0.6 else rng.choice(texts)
        out.append((conv, rng.choice([None, i, i, i, i, i + 3]), role, text))
    return out


def test_damage_and_repair(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF_DIR}/conversations.parquet'").fetchall()
    check(queries.op13_repair(spark, SF_DIR), rows, plain_damage(rows))


def test_damage(spark):
    rows = [r for conv in (None, *range(40)) for r in made(random.Random(conv), conv, 6)]
    got = repair.damaged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_damage(rows)))


def test_repair_of_many_made_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in (None, *range(600)) for r in made(rng, conv, rng.choice([1, 1, 2, 3, 4, 7, 12, 30]))]
    rows += rows[:200]  # repeated rows
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", at string, times int").repartition(5)
    tidied = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    check(repair.report(frame, frame), rows, tidied)


@pytest.mark.parametrize(("block", "fan"), [(8, 4096), (8, 3), (5, 2)])
def test_repair_of_conversations_over_many_blocks(spark, monkeypatch, block, fan):
    monkeypatch.setattr(repair, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(repair, "FAN", fan)
    rng = random.Random(block * fan)
    rows = [r for conv, length in [(None, 21), (1, 150), (2, 3), (3, 8), (4, 40), (5, 1)] for r in made(rng, conv, length)]
    frame = spark.createDataFrame(rows, SCHEMA)
    check(repair.report(frame, frame), rows, [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_halves_choose_the_least_letters():
    import numpy as np

    rng = random.Random(8)
    for _ in range(400):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", f"{i}.", f"{i}", ""])) for i in range(rng.randrange(1, 14))]
        *_, cost, audit, _ = plain_report(rows)
        kinds, seen = [], set()
        for _, role, text in rows:
            kinds.append(repair.DOOMED if not text or (role, text) in seen else repair.WHOLE if text.endswith(".") else repair.TRUNCATED)
            seen.add((role, text))
        tables = repair.TABLES[["sua".find(r[:1]) if r[0] in "sua" else 3 for _, r, _ in rows], kinds]
        halves = repair.Halves(tables, np.zeros(len(rows), np.int64))
        end = repair.closed(halves.whole)
        before, after = halves.ends(np.zeros(1, np.int64), end)
        ways = tables[np.arange(len(rows)), before, after]
        closing = repair.CLOSING[end[0]]
        assert "".join(repair.WORDS[w & 63] for w in ways) + "I" * closing == audit
        assert (ways >> 6).sum() + 5 * closing == cost


def test_repaired_turns_follow_the_pattern(spark):
    frame = spark.createDataFrame([r for conv in range(60) for r in made(random.Random(conv), conv, 9)], SCHEMA)
    turns = repair.repaired(repair.edits(frame))
    assert turns.columns == ["conv_id", "at", "part", "edit", "role", "text"]
    ordered = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "part", "role"))).alias("t"))
    for row in ordered.collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[:1] for t in row.t))


def test_nothing_to_repair(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.report(empty, empty).collect() == [] and repair.damaged(empty).collect() == []
    gone = spark.createDataFrame([(1, 0, "user", "Hi."), (None, None, None, None)], SCHEMA)
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(gone, empty).collect()}
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == {1: nothing, None: nothing}


def test_a_long_text(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "w" * 2_000_000 + ".")]
    frame = spark.createDataFrame(rows, SCHEMA)
    check(repair.report(frame, frame), rows, rows)
