"""Profiling and rule queries over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import profiling as P
from tablesmith.operators import rules as Q
from tablesmith.operators import states
from tablesmith.operators.rules import Rule
from tablesmith.plans.registry import query, table
from tablesmith.session import stage

_LABELLED = "(SELECT d.doc_id, lang, text, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
_LINE_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int", "l_quantity": "double",
    "l_extendedprice": "double", "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
    "l_linestatus": "string", "l_shipdate": "timestamp_ntz",
}


def _labelled(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")


def _profile_sql(source: str, columns: dict[str, str], extra: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, count("{c}") AS non_null,
            count(*) - count("{c}") AS null_count, count(DISTINCT "{c}") AS "unique", count(*) AS row_count,
            CAST(round_even(CAST((count(*) - count("{c}")) * 100 / count(*) AS DECIMAL(28,8)), 2) AS DOUBLE) AS null_percent{extra}
            FROM {source}"""
        for i, (c, t) in enumerate(columns.items())
    )


@query(_profile_sql("lineitem", _LINE_COLUMNS))
def profile_columns(spark, sf_dir):
    return P.profile_columns(table(spark, sf_dir, "lineitem"))


@query(_profile_sql(_LABELLED, {"doc_id": "bigint", "lang": "string", "quality": "int", "toxic": "int"}))
def profile_columns_nulls(spark, sf_dir):
    return P.profile_columns(_labelled(spark, sf_dir).select("doc_id", "lang", "quality", "toxic"))


@query(
    """
    SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
           count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders)) AS duplicate_rows FROM orders
    """
)
def profile_table(spark, sf_dir):
    return P.profile_table(table(spark, sf_dir, "orders"))


@query(
    """
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
           count(*) FILTER (WHERE n > 1) AS duplicated_groups
    FROM (SELECT text, count(*) AS n FROM documents GROUP BY text)
    """
)
def duplicate_rows(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "documents").select("text"), by_digest=True)


@query(
    """
    SELECT 'Duplicate rows detected' AS flag, 'MEDIUM' AS severity, CAST(d AS BIGINT) AS duplicate_rows
    FROM (SELECT count(*) - count(DISTINCT text) AS d FROM documents) WHERE d > 0
    """
)
def quality_flags(spark, sf_dir):
    return P.quality_flags(table(spark, sf_dir, "documents").select("text"), by_digest=True)


@query(
    _profile_sql(
        "customer",
        {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"},
        ", CAST(5 AS BIGINT) AS column_count",
    )
)
def profile_document(spark, sf_dir):
    return P.profile_document(table(spark, sf_dir, "customer"))


def _describe_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
            CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q0,
            round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q2
            FROM {source}"""
        for c in columns
    )


def _rounded(described: DataFrame) -> DataFrame:
    places = {"mean": 4, "std": 4, "q0": 6, "q1": 6, "q2": 6}
    return described.withColumns({c: F.round(c, p) for c, p in places.items()})


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_describe_sql("lineitem", _NUMBERS))
def describe_numeric(spark, sf_dir):
    return _rounded(P.describe(table(spark, sf_dir, "lineitem"), _NUMBERS))


@query(_describe_sql(_LABELLED, ["quality", "n_chars"]))
def column_stats(spark, sf_dir):
    return _rounded(P.describe(_labelled(spark, sf_dir), ["quality", "n_chars"]))


def _top_sql(source: str, column: str, k: int) -> str:
    return f"""SELECT * FROM (SELECT '{column}' AS "column", CAST({column} AS VARCHAR) AS value, count(*) AS n,
               count(*) / (SELECT count({column}) FROM {source}) AS share,
               (SELECT count(DISTINCT {column}) / count({column}) FROM {source}) AS cardinality_ratio
               FROM {source} GROUP BY 2 ORDER BY n DESC, value LIMIT {k})"""


@query(" UNION ALL ".join(_top_sql("lineitem", c, 5) for c in ("l_partkey", "l_returnflag", "l_linenumber")))
def top_values(spark, sf_dir):
    return P.top_values(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag", "l_linenumber"], 5)


@query(
    """
    SELECT regexp_replace(regexp_replace(url, '[A-Za-z]', 'A', 'g'), '[0-9]', '9', 'g') AS pattern, count(*) AS n
    FROM pages GROUP BY 1
    """
)
def value_patterns(spark, sf_dir):
    return P.value_patterns(table(spark, sf_dir, "pages"), "url")


@query("SELECT *, 1000 < (SELECT count(*) FROM orders) AS is_sample FROM orders ORDER BY sha256(CAST(o_orderkey AS VARCHAR)) LIMIT 1000")
def sample_rows(spark, sf_dir):
    """The thousand orders whose keys have the lowest digests."""
    return P.sample_rows(table(spark, sf_dir, "orders"), ["o_orderkey"], 1000)


def _outliers_sql(source: str, column: str) -> str:
    return f"""
    SELECT '{column}' AS "column", round(low, 6) AS low, round(high, 6) AS high,
           count(*) FILTER (WHERE {column} < low) AS below, count(*) FILTER (WHERE {column} > high) AS above
    FROM {source}, (SELECT a - (b - a) * 1.5::DOUBLE AS low, b + (b - a) * 1.5::DOUBLE AS high
         FROM (SELECT quantile_cont({column}, 0.25) AS a, quantile_cont({column}, 0.75) AS b FROM {source}))
    GROUP BY low, high
    """


@query(f"{_outliers_sql('events', 'value')} UNION ALL {_outliers_sql('orders', 'o_totalprice')}")
def outliers_iqr(spark, sf_dir):
    found = P.outliers(table(spark, sf_dir, "events"), ["value"]).unionByName(P.outliers(table(spark, sf_dir, "orders"), ["o_totalprice"]))
    return found.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query(
    f"""
    SELECT 'completeness' AS "check", 'quality' AS name, count(quality) / count(*) AS share FROM {_LABELLED}
    UNION ALL SELECT 'uniqueness', 'text', count(DISTINCT text) / count(text) FROM {_LABELLED}
    UNION ALL SELECT 'consistency', 'length', count(*) FILTER (WHERE n_chars >= 100 AND n_chars = length(text)) / count(*) FROM {_LABELLED}
    UNION ALL SELECT 'consistency', 'toxic is 0 or 1', count(*) FILTER (WHERE toxic IN (0, 1)) / count(*) FROM {_LABELLED}
    """
)
def quality_rules(spark, sf_dir):
    rules = {
        "length": (F.col("n_chars") >= 100) & (F.col("n_chars") == F.length("text")),
        "toxic is 0 or 1": F.col("toxic").isin(0, 1),
    }
    return P.check_columns(_labelled(spark, sf_dir), complete=["quality"], unique=["text"], consistent=rules)


@query(
    """
    SELECT o_custkey, count(*) AS rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0) GROUP BY o_custkey
    """
)
def orphan_keys(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0")
    return P.orphan_keys(table(spark, sf_dir, "orders"), "o_custkey", customers, "c_custkey")


@query(
    """
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows,
           count(*) FILTER (WHERE n > 1) AS duplicated_groups
    FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
    """
)
def duplicate_keys(spark, sf_dir):
    return P.duplicate_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    """
    SELECT count(*) AS total_orders, count(DISTINCT o_custkey) AS unique_customers,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order_value,
           strftime(min(o_orderdate), '%Y-%m-%d') || ' to ' || strftime(max(o_orderdate), '%Y-%m-%d') AS date_range,
           count(DISTINCT o_orderpriority) AS priorities
    FROM orders
    """
)
def order_summary(spark, sf_dir):
    day = F.col("o_orderdate").cast("date").cast("string")
    return table(spark, sf_dir, "orders").agg(
        F.count("*").alias("total_orders"),
        F.count_distinct("o_custkey").alias("unique_customers"),
        C.exact_sum("o_totalprice").alias("total_revenue"),
        C.exact_mean("o_totalprice").alias("avg_order_value"),
        F.concat_ws(" to ", F.min(day), F.max(day)).alias("date_range"),
        F.count_distinct("o_orderpriority").alias("priorities"),
    )


# Rules


def _order_flags(spark, sf_dir, keep_unflagged: bool = False) -> DataFrame:
    rules = [
        Rule("Large order", "HIGH", F.col("o_totalprice") > 450000, "total above 450000"),
        Rule("Old order", "MEDIUM", F.col("o_orderdate") < "1996-01-01", F.concat(F.lit("from "), F.date_format("o_orderdate", "yyyy"))),
        Rule("No priority", "LOW", F.col("o_orderpriority") == "4-NOT SPECIFIED"),
    ]
    orders = table(spark, sf_dir, "orders")
    return Q.flag_rows(orders, rules, ["o_orderkey", "o_custkey"], keep_unflagged)


_ORDER_FLAGS = """(
    SELECT o_orderkey, o_custkey, 'Large order' AS flag, 'HIGH' AS severity, 'total above 450000' AS detail
    FROM orders WHERE o_totalprice > 450000
    UNION ALL SELECT o_orderkey, o_custkey, 'Old order', 'MEDIUM', 'from ' || CAST(year(o_orderdate) AS VARCHAR)
    FROM orders WHERE o_orderdate < '1996-01-01'
    UNION ALL SELECT o_orderkey, o_custkey, 'No priority', 'LOW', ''
    FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED')"""


@query(f"SELECT * FROM {_ORDER_FLAGS}")
def rule_flags(spark, sf_dir):
    return _order_flags(spark, sf_dir)


@query(
    f"""
    SELECT s.severity, count(f.severity) AS findings
    FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW']) AS severity) s LEFT JOIN {_ORDER_FLAGS} f
         ON s.severity = f.severity GROUP BY s.severity
    """
)
def severity_summary(spark, sf_dir):
    return Q.severity_summary(_order_flags(spark, sf_dir))


@query(f"SELECT * FROM {_ORDER_FLAGS} WHERE severity IN ('CRITICAL', 'HIGH', 'MEDIUM')")
def severity_filter(spark, sf_dir):
    return Q.at_least(_order_flags(spark, sf_dir), "MEDIUM")


@query(
    f"""
    SELECT o.o_custkey, coalesce(high, 0) AS high,
           CASE WHEN high > 3 THEN 'CRITICAL' WHEN high > 0 THEN 'HIGH' ELSE 'LOW' END AS risk_level
    FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN
         (SELECT o_custkey, count(*) AS high FROM {_ORDER_FLAGS} WHERE severity = 'HIGH' GROUP BY o_custkey) f
         ON o.o_custkey = f.o_custkey
    """
)
def risk_level(spark, sf_dir):
    return Q.risk_level(_order_flags(spark, sf_dir, keep_unflagged=True), ["o_custkey"])


@query(
    """
    WITH t AS (
        SELECT unnest(['event_id', 'user_id', 'event_type', 'value', 'ts']) AS "column",
            unnest([min(event_id)::VARCHAR, min(user_id)::VARCHAR, min(event_type), min(value)::VARCHAR, min(ts)::VARCHAR]) AS least,
            unnest([max(event_id)::VARCHAR, max(user_id)::VARCHAR, max(event_type), max(value)::VARCHAR, max(ts)::VARCHAR]) AS largest,
            unnest([count(event_id), count(user_id), count(event_type), count(value), count(ts)]) AS present, count(*) AS rows
        FROM events
    )
    SELECT "column", rows, rows - present AS nulls, least, largest, true AS distinct_near, true AS quantiles_near FROM t
    """
)
def profile_of_days(spark, sf_dir):
    """Profile states kept by day and merged to the whole: counts and extremes, and whether the sketches are as near as they should be."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")
    days = stage(states.profile_states(events.withColumn("day", F.to_date("ts")), ["day"]), "states")
    found = states.state_profile(states.merged_states(days), (0.1, 0.5, 0.9))
    # the exact numbers of distinct values, and the exact ranks of the estimated quantiles
    numbers = ["event_id", "user_id", "value"]
    exact = P.profile_columns(events).select("column", "unique")
    values = P.long_form(events, numbers).where("value IS NOT NULL")
    shares = values.join(F.broadcast(found.where(F.col("q0").isNotNull()).select("column", "q0", "q1", "q2")), "column").groupBy("column").agg(
        *[(F.count_if(F.col("value") <= F.col(f"q{i}")) / F.count("*")).alias(f"upto{i}") for i in range(3)], *[(F.count_if(F.col("value") < F.col(f"q{i}")) / F.count("*")).alias(f"below{i}") for i in range(3)]
    )
    near = F.lit(True)
    for i, share in enumerate((0.1, 0.5, 0.9)):
        near = near & (F.col(f"below{i}") <= share + states.RANK_ERROR) & (F.col(f"upto{i}") >= share - states.RANK_ERROR)
    both = found.join(exact, "column").join(shares, "column", "left")
    close = F.abs(F.col("distinct") - F.col("unique")) <= F.greatest(F.lit(1), F.col("unique") * states.DISTINCT_ERROR)
    return both.select("column", "rows", "nulls", "least", "largest", close.alias("distinct_near"), F.coalesce(near, F.lit(True)).alias("quantiles_near"))
