"""Window operators with groups cut into blocks, against pandas."""

import functools
import os
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablesmith.operators import splits, windows
from tablesmith.plans import workflow
from tablesmith.session import discard, scratch_dir, stage


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 2000
    values = rng.integers(0, 30, n).astype(float)
    values[rng.random(n) < 0.4] = 7
    values[rng.random(n) < 0.1] = np.nan
    groups = rng.choice(["a", "b", "c'\\", None], n, p=[0.4, 0.3, 0.2, 0.1]).astype(object)
    return pd.DataFrame({"id": rng.permutation(n), "g": groups, "v": values}).sort_values("id", ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, rows):
    data = [(int(i), g, None if np.isnan(v) else float(v)) for i, g, v in rows.itertuples(index=False)]
    return spark.createDataFrame(data, "id long, g string, v double").repartition(5, "v").cache()


@pytest.fixture(params=[100, 10**9], ids=["blocks", "plain"])
def blocks(request, monkeypatch):
    cut = functools.partial(splits.find_splits, rows_per_block=request.param)
    monkeypatch.setattr(windows, "find_splits", cut)
    return request.param


def check(result, name, expected):
    got = result.toPandas().sort_values("id", ignore_index=True)[name].astype(float)
    assert np.allclose(got, expected.astype(float), equal_nan=True)


def test_splits_only_large_groups(frame):
    found = splits.find_splits(frame, ["g"], ["id"], rows_per_block=300)
    assert {p[0] for p in found.points} <= {"a", "b", "c'\\"} and found
    assert not splits.find_splits(frame, ["id"], [], rows_per_block=100)


@pytest.mark.parametrize("by", [["g"], []])
def test_running_total(frame, rows, blocks, by):
    expected = (rows.groupby(by, dropna=False)["v"] if by else rows["v"]).cumsum()
    check(windows.running_total(frame, "v", ["id"], by), "running_total", expected)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("ascending", [True, False])
def test_average_rank(frame, rows, blocks, by, ascending):
    expected = (rows.groupby(by, dropna=False)["v"] if by else rows["v"]).rank(ascending=ascending)
    check(windows.average_rank(frame, "v", by, ascending), "rank", expected)


def test_percent_rank(frame, rows, blocks):
    check(windows.average_rank(frame, "v", percent=True), "rank", rows["v"].rank(pct=True) * 100)


@pytest.mark.parametrize("by", [["g"], []])
def test_rolling_mean(frame, rows, blocks, by):
    expected = rows["v"].rolling(7, min_periods=1).mean()
    if by:
        rolled = rows.groupby(by, dropna=False)["v"].rolling(7, min_periods=1).mean()
        expected = rolled.reset_index(level=0, drop=True).sort_index()
    check(windows.rolling_mean(frame, "v", 7, ["id"], by), "rolling_mean", expected)


@pytest.mark.parametrize("by", [["g"], []])
def test_fills(frame, rows, blocks, by):
    source = rows.groupby(by, dropna=False)["v"] if by else rows["v"]
    check(windows.forward_fill(frame, "v", ["id"], by), "v", source.ffill())
    check(windows.backward_fill(frame, "v", ["id"], by), "v", source.bfill())


def test_z_score(frame, rows):
    check(windows.z_score(frame, "v"), "z_score", (rows.v - rows.v.mean()) / rows.v.std())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-3, 3)), min_size=1, max_size=60))
def test_rank_equals_pandas(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v int")
    check(windows.average_rank(df, "v"), "rank", pd.Series(values, dtype="Float64").rank())


def test_both_ways_to_find_a_block_agree(frame, monkeypatch):
    found = splits.find_splits(frame, ["g"], ["v", "id"], rows_per_block=50)
    assert len(found.points) > 20
    compared = frame.withColumn("a", found.block())
    monkeypatch.setattr(splits, "FEW_POINTS", 0)
    both = compared.withColumn("b", found.block())
    assert both.where("a <> b").count() == 0 and both.select("a").distinct().count() > len(found.points)


def test_blocks_among_many_points_are_compiled(frame):
    found = splits.find_splits(frame, ["g"], ["v", "id"], rows_per_block=10)
    assert len(found.points) > splits.FEW_POINTS
    both = found.with_block(frame, "a").withColumn("b", found.block())
    assert both.where("NOT a <=> b").count() == 0 and both.select("a").distinct().count() > len(found.points)
    inside = frame.withColumn("inside", found.in_split_group()).groupBy("inside").agg(F.collect_set(F.coalesce("g", F.lit("none"))).alias("g"))
    assert {g for row in inside.where("inside").collect() for g in row.g} == {p[0] or "none" for p in found.points}
    totals = windows.running_total(frame, "v", ["v", "id"], ["g"], splits=found)
    for plan in (p._jdf.queryExecution().executedPlan().toString() for p in (found.with_block(frame, "a"), totals)):
        assert "lambdafunction" not in plan


def test_workflow_deletes_what_no_later_step_reads(spark, tmp_path):
    tables = {
        "customer": ([(i, f"name {i}", "BUILDING") for i in range(5)], "c_custkey long, c_name string, c_mktsegment string"),
        "orders": ([(i, i % 6, f"1995-01-{1 + i % 28:02d}", 10.0 * i) for i in range(40)], "o_orderkey long, o_custkey long, o_orderdate string, o_totalprice double"),
        "lineitem": ([(i % 40, i % 7, 1.0 + i, 5.0 * i) for i in range(90)], "l_orderkey long, l_partkey long, l_quantity double, l_extendedprice double"),
        "part": ([(i, "PROMO", 3.0) for i in range(6)], "p_partkey long, p_type string, p_retailprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    folder = Path(scratch_dir(spark).removeprefix("file:"))
    before = set(os.listdir(folder)) if folder.exists() else set()
    got = workflow.order_workflow(spark, str(tmp_path)).first()
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and min(left).startswith("workflow-")
    outputs = folder / min(left)
    assert spark.read.parquet(f"{outputs}/windows").count() == spark.read.csv(f"{outputs}/complete_orders_csv", header=True).count() == got.total_orders == 87
    assert {p.name for p in (outputs / "summaries").iterdir() if p.is_dir()} >= {"customers", "categories", "temporal"}


def test_a_discarded_table_is_gone(spark):
    one, two = stage(spark.range(5), "one"), stage(spark.range(6), "two")
    path = one.inputFiles()[0].removeprefix("file://")
    discard(one)
    assert not os.path.exists(os.path.dirname(path)) and two.count() == 6
    with pytest.raises(KeyError):
        discard(one)
