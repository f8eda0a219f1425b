import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tablesmith.operators import reconcile as V

SCHEMA = "k int, v string, x double"
SOURCE = [(1, "a", 1.0), (1, "a", 1.0), (2, None, 2.0), (4, "d", 4.0)]
TARGET = [(1, "a", 1.0), (2, None, 2.0), (3, "c", 3.0), (4, "d", 4.5)]
quick = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame(SOURCE, SCHEMA), spark.createDataFrame(TARGET, SCHEMA)


def test_counts_and_schema(pair):
    assert V.row_counts(*pair).first().asDict() == {"source_rows": 4, "target_rows": 4, "row_count_match": True}
    assert V.schema_match(*pair)


def test_row_diff(pair):
    found = {tuple(r) for r in V.row_diff(*pair).collect()}
    assert found == {(1, "a", 1.0, 1), (3, "c", 3.0, -1), (4, "d", 4.0, 1), (4, "d", 4.5, -1)}


def test_row_diff_matches_columns_by_name(pair):
    source, target = pair
    assert V.row_diff(source, source.select("x", "k", "v")).count() == 0


def test_row_diff_with_maps_and_variants(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, parse_json('{\"a\": 1}') AS j")
    other = spark.sql("SELECT map('b', 2, 'a', 1) AS m, parse_json('{\"a\": 1}') AS j")
    assert V.row_diff(df, other).count() == 0


def test_keyed_diff_refuses_repeated_keys(pair):
    with pytest.raises(ValueError, match="not unique in the source"):
        V.keyed_diff(*pair, ["k"])


def test_keyed_diff(pair):
    source, target = pair
    found = {tuple(r) for r in V.keyed_diff(source.distinct(), target, ["k"]).collect()}
    assert found == {(3, "extra", None, None, None), (4, "changed", "x", "4.0", "4.5")}
    assert V.keyed_diff(source.distinct(), target.where("k <> 3"), ["k"], tolerance={"x": 0.5}).count() == 0


def test_schema_diff(spark, pair):
    other = spark.createDataFrame([(1, 2.0, True)], "k long, x double, extra boolean")
    found = {(r["column"], r["issue"]) for r in V.schema_diff(pair[0], other).collect()}
    assert found == {("k", "type_changed"), ("v", "missing_in_target"), ("extra", "missing_in_source")}


def test_issues_and_summary(spark, pair):
    found = {r["type"]: (r["source"], r["target"]) for r in V.issues(*pair).collect()}
    assert found == {"rows": ("2", "2")}
    assert V.summary(V.issues(*pair)).first().asDict() == {"row_count_match": True, "schema_match": True, "data_discrepancies": 1}
    assert V.issues(pair[0], pair[0]).count() == 0
    assert {r["type"] for r in V.issues(pair[0], pair[1].limit(1).drop("x")).collect()} == {"row_count", "schema", "rows"}


def test_key_sample_keeps_the_same_keys(spark):
    left, right = spark.range(2000), spark.range(2000).repartition(5)
    a = {r.id for r in V.key_sample(left, ["id"], 10).collect()}
    assert a == {r.id for r in V.key_sample(right, ["id"], 10).collect()} and 100 < len(a) < 300


rows = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.sampled_from("ab"))), max_size=20)


@quick
@given(rows)
def test_a_table_equals_itself(spark, data):
    df = spark.createDataFrame(data, "k int, v string")
    assert V.row_diff(df, df.repartition(3)).count() == 0


@quick
@given(st.sets(st.integers(0, 30)), st.sets(st.integers(0, 30)))
def test_keyed_diff_finds_the_edits(spark, dropped, changed):
    source = spark.createDataFrame([(i, float(i)) for i in range(31)], "k int, x double")
    target = [(i, float(i) + (1 if i in changed else 0)) for i in range(31) if i not in dropped]
    found = V.keyed_diff(source, spark.createDataFrame(target, "k int, x double"), ["k"]).collect()
    assert {r["k"] for r in found if r["change"] == "missing"} == dropped
    assert {r["k"] for r in found if r["change"] == "changed"} == changed - dropped


def test_null_keys_and_changed_types(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    assert V.keyed_diff(df, df, ["k"]).count() == 0
    wide = df.withColumn("k", F.col("k").cast("bigint"))
    assert V.row_diff(df, wide).count() == 0 and V.keyed_diff(df, wide, ["k"]).count() == 0
    assert [(r.type, r.source, r.target) for r in V.issues(df, wide).collect()] == [("type", "k int", "k bigint")]
    both = [{r.k for r in V.key_sample(side, ["k"], 50).collect()} for side in (spark.range(100).select(F.col("id").cast("int").alias("k")), spark.range(100).withColumnRenamed("id", "k"))]
    assert both[0] == both[1]


def test_bucket_diff_reads_few_rows_and_finds_all(spark):
    rows = [(None if i == 7 else i, f"n{i}", float(i), None if i % 3 else i) for i in range(5000)]
    edited = [(k, n, v + 1 if k in (10, 2500) else v, None if k == 33 else o) for k, n, v, o in rows if k != 77] + [(9999, "new", 0.0, None)]
    schema = "k bigint, n string, v double, o bigint"
    source, target = spark.createDataFrame(rows, schema), spark.createDataFrame(edited, schema)
    found = sorted(map(str, V.bucket_diff(source, target, ["k"], branches=64).collect()))
    assert found == sorted(map(str, V.keyed_diff(source, target, ["k"]).collect())) and len(found) == 5
    left, right = V.differing_buckets(source, target, ["k"], branches=64)
    assert left.count() < 40 and right.count() < 40
    assert V.bucket_diff(source, source, ["k"]).collect() == []
    none = source.where("false")
    assert V.bucket_diff(source, none, ["k"]).count() == 5000 and V.bucket_diff(none, none, ["k"]).count() == 0
    # which column holds a null, and how often a row stands, makes a difference
    one, other = spark.createDataFrame([(1, None, "a")], "k int, a string, b string"), spark.createDataFrame([(1, "a", None)], "k int, a string, b string")
    assert V.bucket_diff(one, other, ["k"]).count() == 2
