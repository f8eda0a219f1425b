import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.functions.columns import SEVERITIES
from tablesmith.operators import profiling, rules
from tablesmith.operators.rules import Rule


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    profile = {r["column"]: r for r in profiling.profile_columns(df).collect()}
    assert profile["a"]["row_count"] == 0 and profile["a"]["null_percent"] is None
    assert profiling.profile_table(df).first().asDict() == {"total_rows": 0, "total_columns": 2, "duplicate_rows": 0}
    assert profiling.quality_flags(df).count() == 0


def test_profile_counts_nulls_and_map_columns(spark):
    df = spark.createDataFrame([(1, None, {"a": 1}), (2, "x", {"a": 1}), (2, "x", None)], "a int, `b c` string, m map<string,int>")
    profile = {r["column"]: r for r in profiling.profile_columns(df).collect()}
    assert profile["b c"]["null_count"] == 1 and profile["b c"]["null_percent"] == 33.33
    assert profile["m"]["unique"] == 1
    digests = {r["column"]: r["unique"] for r in profiling.profile_columns(df.drop("m"), by_digest=["b c"]).collect()}
    assert digests == {"a": 2, "b c": 1}
    assert profiling.duplicate_rows(df).first()["duplicate_rows"] == 0


def test_digest_keeps_nulls_and_empty_texts_apart(spark):
    df = spark.createDataFrame([(None,), ("",), ("",), (None,)], "t string")
    assert profiling.duplicate_rows(df, by_digest=True).first()["duplicate_rows"] == 2


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(profiling, "ACCURACY", accuracy)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50, 900).astype(float), rng.normal(size=900)
    a[rng.random(900) < 0.4] = 13
    df = spark.createDataFrame([(float(x), float(y), None) for x, y in zip(a, b)] + [(None, float("nan"), None)], "a double, b double, none double")
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r["column"]: [r[f"q{i}"] for i in range(len(shares))] for r in profiling.quantiles(df, ["a", "b", "none"], shares).collect()}
    assert np.allclose(got.pop("a"), np.quantile(a, shares)) and np.allclose(got.pop("b"), np.quantile(b, shares)) and not got


def test_quantiles_of_many_rows_sort_few(spark):
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    value = F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.xxhash64("id"), F.lit(10**9)) / 1e8)
    df = spark.range(300_000).select(value.alias("v"))
    rows = np.sort(np.array([r.v for r in df.collect()]))
    row = profiling._bounds(df, ["v"], shares)
    inside = sum(((rows >= low) & (rows <= high) & (rows != 5.0)).sum() for low, high in profiling._regions(row, 0))
    assert inside < 0.01 * len(rows)
    got = profiling._quantiles(df, ["v"], shares, row).first()
    assert np.allclose([got[f"q{i}"] for i in range(len(shares))], np.quantile(rows, shares))


def test_describe_of_nothing(spark):
    row = profiling.describe(spark.createDataFrame([(None,)], "a double"), ["a"]).first()
    assert row["count"] == 0 and row["mean"] is None and row["q0"] is None


def test_sample_is_repeatable_and_marked(spark):
    df = spark.range(5000)
    first = {r.id for r in profiling.sample_rows(df, ["id"], 50).collect()}
    assert first == {r.id for r in profiling.sample_rows(df.repartition(7), ["id"], 50).collect()} and len(first) == 50
    same_key = df.select(F.lit(1).alias("k"))
    assert profiling.sample_rows(same_key, ["k"], 50).count() == 50


def test_write_profile(spark, tmp_path):
    df = spark.createDataFrame([(1,), (1,)], "a int")
    profiling.write_profile(df, str(tmp_path), "t.csv")
    assert spark.read.json(f"{tmp_path}/schema").first()["file"] == "t.csv"
    assert spark.read.json(f"{tmp_path}/flags").first()["flag"] == "Duplicate rows detected"


def test_rules_and_levels(spark):
    df = spark.createDataFrame([("f", i) for i in range(5)] + [("g", 9), ("h", None)], "file string, n int")
    flags = rules.flag_rows(df, [Rule("small", "HIGH", F.col("n") < 4, "x"), Rule("nine", "LOW", F.col("n") == 9)], ["file"], True)
    levels = {r["file"]: r["risk_level"] for r in rules.risk_level(flags, ["file"]).collect()}
    assert levels == {"f": "CRITICAL", "g": "LOW", "h": "LOW"}
    counts = {r["severity"]: r["findings"] for r in rules.severity_summary(flags).collect()}
    assert counts == {"CRITICAL": 0, "HIGH": 4, "MEDIUM": 0, "LOW": 1} and list(counts) == list(SEVERITIES)
    assert rules.at_least(flags, "HIGH").count() == 4
