"""Many patterns at once against a plain search."""

import random

import pytest

from tablesmith.operators import automaton, ranking

SCHEMA = "id bigint, text string"


def plain(text, pattern):
    places = [i for i in range(len(text)) if text.startswith(pattern, i)]
    around = [(i == 0 or text[i - 1].isspace()) and (i + len(pattern) == len(text) or text[i + len(pattern)].isspace()) for i in places]
    return (len(places), any(around)) if places else None


@pytest.mark.parametrize("cells", [automaton.MOST_CELLS, 200])
def test_occurrences(spark, cells, monkeypatch):
    monkeypatch.setattr(automaton, "LANES", 7)
    rng = random.Random(4)
    letters = "ab é日\U0001f600\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(60)] + [None, "a", "aa", "aaa a", "a" * 5000]
    patterns = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 6))) for _ in range(60)} | {"a", "aa", "aaaa", "", "b a"}
    frame = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = {(r.id, r.pattern): (r.times, r.whole) for r in automaton.occurrences(frame, "text", sorted(patterns), ["id"], cells).collect()}
    want = {(i, p): plain(t, p) for i, t in enumerate(texts) if t for p in patterns if p and plain(t, p)}
    assert got == want


def test_tables_stay_in_their_bound():
    patterns = [f"word{i}" for i in range(3000)]
    parts = list(automaton.tables(patterns, 20_000))
    assert sorted(p for part in parts for p in part) == sorted(patterns) and len(parts) > 3
    assert all(automaton.Automaton(part).steps.size <= 20_000 for part in parts)


def test_nothing_to_find(spark):
    frame = spark.createDataFrame([(1, "x")], SCHEMA)
    assert automaton.occurrences(frame, "text", [], ["id"]).collect() == [] == automaton.occurrences(frame, "text", ["y", ""], ["id"]).collect()
    assert automaton.occurrences(frame.where("false"), "text", ["x"], ["id"]).collect() == []


def test_a_catalog_as_a_table_scores_as_one_in_the_plan(spark):
    entries = [ranking.Entry("a", ("red", "blue sky"), "when the sky is blue"), ranking.Entry("b", ("ed", "Sky"), "red or not")]
    texts = [(1, "The red sky"), (2, "a blue sky, colored"), (3, ""), (4, None), (5, "RED or blue skY")]
    messages = spark.createDataFrame(texts, SCHEMA)
    rows = [(e.name, k, False) for e in entries for k in e.keywords] + [(e.name, w, True) for e in entries for w in set(e.when_to_use.split())]
    catalog = spark.createDataFrame(rows, "entry string, keyword string, shared boolean")
    mine = {(r.id, r.entry): r.score for r in ranking.catalog_scores(messages, "text", catalog, ["id"]).collect()}
    theirs = {(r.id, r.entry): r.score for r in ranking.keyword_scores(messages.where("text IS NOT NULL"), "text", entries, ["id"]).collect() if r.score > 0}
    assert mine == theirs and len(mine) >= 5
