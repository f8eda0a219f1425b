"""Profile states merged against the profile of the whole."""

import random

from pyspark.sql import functions as F

from tablesmith.operators import profiling, states

SCHEMA = "part int, n bigint, x double, s string, d date, a array<int>, empty string"


def rows():
    rng = random.Random(2)
    return [
        (p, rng.randrange(-50, 5000) if rng.random() < 0.9 else None, rng.choice([rng.gauss(0, 1), float("nan"), None]), f"v{rng.randrange(300)}", None, [rng.randrange(4)], None)
        for p in range(12) for _ in range(rng.choice([0, 1, 40, 900]))
    ]


def test_merged_states_tell_the_whole(spark):
    made = rows()
    frame = spark.createDataFrame(made, SCHEMA)
    kept = states.profile_states(frame, ["part"])
    assert kept.columns == ["part", "column", "dtype", "rows", "present", "least", "largest", "distinct_state", "quantile_state"]
    halves = states.merged_states(kept.withColumn("half", F.col("part") % 2), ["half"])
    found = {r.column: r for r in states.state_profile(states.merged_states(halves)).collect()}
    exact = {r.column: r for r in profiling.profile_columns(frame.drop("part")).collect()}
    assert found.keys() == exact.keys()
    for name, r in found.items():
        assert (r.rows, r.nulls) == (len(made), exact[name].null_count)
        assert abs(r.distinct - exact[name].unique) <= max(1, exact[name].unique * states.DISTINCT_ERROR)
    numbers = sorted(r[1] for r in made if r[1] is not None)
    assert (found["n"].least, found["n"].largest) == (str(numbers[0]), str(numbers[-1])) and found["empty"].least is None
    for share, value in ((0.25, found["n"].q0), (0.5, found["n"].q1), (0.75, found["n"].q2)):
        below, upto = sum(v < value for v in numbers), sum(v <= value for v in numbers)
        assert below / len(numbers) <= share + states.RANK_ERROR and upto / len(numbers) >= share - states.RANK_ERROR
    assert found["s"].q0 is None and found["empty"].q0 is None and found["empty"].distinct == 0


def test_direct_and_merged_agree_on_small_parts(spark):
    frame = spark.createDataFrame(rows()[:60], SCHEMA)
    whole = states.state_profile(states.profile_states(frame.drop("part"))).drop("q0", "q1", "q2")
    merged = states.state_profile(states.merged_states(states.profile_states(frame, ["part"]))).drop("q0", "q1", "q2")
    assert sorted(map(str, whole.select(sorted(whole.columns)).collect())) == sorted(map(str, merged.select(sorted(merged.columns)).collect()))


def test_no_rows(spark):
    none = states.profile_states(spark.createDataFrame([], SCHEMA))
    assert {(r.column, r.rows, r.nulls, r.q0) for r in states.state_profile(none).collect()} == {(c, 0, 0, None) for c in ("part", "n", "x", "s", "d", "a", "empty")}
    assert states.merged_states(states.profile_states(spark.createDataFrame([], SCHEMA), ["part"])).collect() == []


def test_nan_is_missing(spark):
    frame = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    row = profiling.describe(frame, ["v"]).first()
    assert (row["count"], row["mean"], row["max"], row["q1"]) == (2, 2.0, 3.0, 2.0)
    assert profiling.profile_columns(frame).first().null_count == 1
