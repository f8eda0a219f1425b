import functools

import pytest
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import ranking, relational, splits, udfs
from tablesmith.operators.ranking import Entry


def test_merge_forms(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (4, "z")], "k int, v string")
    assert relational.merge(left, right, "k").columns == ["k", "v_x", "v_y"]
    assert relational.merge(left, right, "k").count() == 1
    assert relational.merge(left, right, "k", null_equal=True).count() == 2
    outer = relational.merge(left, right, "k", how="outer", null_equal=True)
    assert {r["k"] for r in outer.collect()} == {1, None, 3, 4} and outer.count() == 4
    kept = relational.merge(left, right.withColumnRenamed("k", "j"), left_on="k", right_on="j", suffixes=("", "_r"))
    assert kept.columns == ["k", "v", "j", "v_r"]
    with pytest.raises(ValueError):
        relational.merge(left, right)


@pytest.mark.parametrize("null_equal", [False, True])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_salted_and_nothing_is_lost(spark, monkeypatch, how, null_equal):
    monkeypatch.setattr(relational, "hot_keys", functools.partial(splits.hot_keys, rows_per_key=200))
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 5 != 0, F.col("id"))
    left = spark.range(3000).select("id", key.alias("k"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).union(
        spark.createDataFrame([(7, 70), (None, -5)], "k long, w long")
    )
    assert set(splits.hot_keys(left, ["k"], 200).points) == {("7",), (None,)}

    def rows(df):
        return sorted(map(tuple, df.fillna(-1).collect()))

    plain = relational.merge(left, right, "k", how=how, null_equal=null_equal)
    salted = relational.merge(left, right, "k", how=how, null_equal=null_equal, spread_hot="left")
    assert salted.columns == plain.columns == ["k", "id", "w"]
    assert rows(salted) == rows(plain)
    back = relational.merge(right, left, "k", how=how, null_equal=null_equal)
    assert rows(relational.merge(right, left, "k", how=how, null_equal=null_equal, spread_hot="right")) == rows(back)
    with pytest.raises(ValueError, match="inner and left"):
        relational.merge(left, right, "k", how="outer", spread_hot="left")


def test_group_by_drops_null_keys(spark):
    df = spark.createDataFrame([(1,), (None,)], "k int")
    assert relational.group_by(df, "k").count().count() == 1
    assert relational.group_by(df, "k", dropna=False).count().count() == 2


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert [r.v for r in relational.sort_values(df, ["v"]).collect()] == [1, 2, None]
    assert [r.v for r in relational.sort_values(df, ["v"], False).collect()] == [2, 1, None]


def test_keep_first_fill_and_concat(spark):
    df = spark.createDataFrame([(1, 3, None), (1, 2, 5.0), (2, 1, 7.0)], "k int, o int, v double")
    assert sorted(map(tuple, relational.keep_first(df, ["k"], ["o"]).collect())) == [(1, 2, 5.0), (2, 1, 7.0)]
    assert relational.fill_means(df, ["v"]).where("k = 1 AND o = 3").first()["v"] == 6.0
    both = relational.concat([df, df.select("k")])
    assert both.count() == 6 and both.where("o IS NULL").count() == 3


def test_pivot_without_null_keys(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4), ("b", "y", 8)], "i string, c string, v int")
    values = relational.distinct_values(df, "c")
    wide = relational.pivot_table(df, ["i"], "c", values, {"sum": F.sum("v")}, fill_value=0)
    assert sorted(map(tuple, wide.collect())) == [("a", 1, 0), ("b", 0, 8)]
    with pytest.raises(ValueError, match="more than 1"):
        relational.distinct_values(df, "c", limit=1)


def test_columns(spark):
    df = spark.createDataFrame([(0.0, " A b ", "7"), (100.0, None, ""), (100.5, "c", "abc")], "x double, t string, q string")
    rows = df.select(
        C.cut("x", [0, 100, 500], ["low", "high"]).alias("bin"), C.tidy("t").alias("t"), C.cast_or("q", "int", 0).alias("q"),
        C.truthy("q").alias("full"), C.is_in("t", ["c"]).alias("c"), C.categorical("t", ["c"]).alias("cat"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        (None, "a_b", 7, True, False, None), ("low", "unknown", 0, False, False, None), ("high", "c", 0, True, True, "c"),
    ]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.select(F.col("q").cast("int")).collect()


@pytest.mark.parametrize(("value", "places", "expected"), [("2.5", 0, 2.0), ("0.125", 2, 0.12), ("1.015", 2, 1.02), ("0.135", 2, 0.14)])
def test_round_even(spark, value, places, expected):
    assert spark.range(1).select(C.round_even(F.lit(value).cast("double"), places).alias("r")).first()["r"] == expected


def test_replace_words_keeps_parts_of_words(spark):
    df = spark.createDataFrame([("old older _old old$ OLD",)], "t string")
    assert df.select(C.replace_words("t", {"old": "n$w"}).alias("t")).first()["t"] == "n$w older _old n$w$ OLD"


def test_keyword_ranking(spark):
    catalog = [Entry("A", ("copy data", "archive"), "please copy this file"), Entry("B", ("zebra",)), Entry("C", ("arch",))]
    df = spark.createDataFrame([(1, "Please copy data to archive"), (2, "nothing")], "id int, m string")
    scores = {(r["id"], r["entry"]): r["score"] for r in ranking.keyword_scores(df, "m", catalog, ["id"]).collect()}
    assert scores[1, "A"] == 5.0 and scores[1, "C"] == 1.0 and scores[2, "A"] == 0.0
    top = [tuple(r) for r in ranking.keyword_topk(df, "m", catalog, ["id"], k=3).collect()]
    assert top == [(1, 1, "A", 5.0), (1, 2, "C", 1.0)]


def test_user_aggregate_merges_partial_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).repartition(7)

    def partial(frame):
        return frame.groupby("g")["v"].agg(low="min", high="max").reset_index()

    found = udfs.aggregate_groups(df, ["g"], partial, "low double, high double", {"r": F.max("high") - F.min("low")})
    assert {r["g"]: r["r"] for r in found.collect()} == {0: 999.0, 1: 996.0, 2: 996.0}
