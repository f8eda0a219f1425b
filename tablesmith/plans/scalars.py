"""Column functions and user functions over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import udfs as U
from tablesmith.plans.registry import query, table


@query(
    """
    SELECT c_custkey, upper(c_name) AS name_upper, lower(c_name) AS name_lower, CAST(length(c_name) AS BIGINT) AS name_length
    FROM customer
    """
)
def str_case_len(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("name_upper"),
        F.lower("c_name").alias("name_lower"),
        F.length("c_name").cast("bigint").alias("name_length"),
    )


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)WIDGET|BOLT')")
def str_contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_name").where(F.col("p_name").rlike("(?i)WIDGET|BOLT"))


@query("SELECT c_custkey, replace(c_name, '#', ' ') AS name_clean FROM customer")
def str_replace(spark, sf_dir):
    clean = F.replace(F.col("c_name"), F.lit("#"), F.lit(" "))
    return table(spark, sf_dir, "customer").select("c_custkey", clean.alias("name_clean"))


@query(
    """
    SELECT p_partkey, nullif(split_part(p_name, ' ', 1), '') AS first, nullif(split_part(p_name, ' ', 2), '') AS second,
           nullif(split_part(p_name, ' ', 3), '') AS third
    FROM part
    """
)
def str_split_expand(spark, sf_dir):
    first, second, third = C.split_parts("p_name", " ", 3)
    return table(spark, sf_dir, "part").select("p_partkey", first.alias("first"), second.alias("second"), third.alias("third"))


@query(
    """
    SELECT p_partkey, coalesce(replace(lower(trim(label)), ' ', '_'), 'unknown') AS label
    FROM (SELECT p_partkey, CASE WHEN p_type <> 'PROMO' THEN '  ' || upper(p_name) || ' ' END AS label FROM part)
    """
)
def str_normalise(spark, sf_dir):
    label = F.when(F.col("p_type") != "PROMO", F.concat(F.lit("  "), F.upper("p_name"), F.lit(" ")))
    return table(spark, sf_dir, "part").select("p_partkey", C.tidy(label).alias("label"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ': ' || CAST(o_custkey AS VARCHAR) AS summary FROM orders")
def row_format(spark, sf_dir):
    summary = F.format_string("%d: %d", "o_orderkey", "o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", summary.alias("summary"))


@query(
    """
    SELECT o_orderkey, o_orderdate AS strict,
           CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END AS lenient
    FROM orders
    """
)
def parse_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    messy = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("on "), text)).otherwise(text)
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd")).alias("strict"),
        F.try_to_timestamp(messy, F.lit("yyyy-MM-dd")).cast("timestamp_ntz").alias("lenient"),
    )


@query(
    """
    SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS period_month,
           CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS period_quarter
    FROM orders
    """
)
def date_parts(spark, sf_dir):
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year(date).alias("year"),
        F.month(date).alias("month"),
        date.cast("date").alias("day"),
        F.date_format(date, "yyyy-MM").alias("period_month"),
        F.date_format(date, "yyyy'Q'q").alias("period_quarter"),
    )


@query(
    """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS as_text, CAST(p_size AS DOUBLE) AS as_double,
           CAST(trunc(p_retailprice) AS INTEGER) AS as_int, p_type <> 'PROMO' AS as_bool
    FROM part
    """
)
def cast_types(spark, sf_dir):
    kind = F.when(F.col("p_type") == "PROMO", "").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_partkey").cast("string").alias("as_text"),
        F.col("p_size").cast("string").cast("double").alias("as_double"),
        F.col("p_retailprice").cast("int").alias("as_int"),
        C.truthy(kind).alias("as_bool"),
    )


@query(
    """
    SELECT o_orderkey, coalesce(TRY_CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR)
           WHEN o_orderkey % 3 = 1 THEN o_orderpriority END AS INTEGER), 0) AS number
    FROM orders
    """
)
def cast_fallback(spark, sf_dir):
    case = F.col("o_orderkey") % 3
    text = F.when(case == 0, F.col("o_custkey").cast("string")).when(case == 1, F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.cast_or(text, "int", 0).alias("number"))


@query(
    """
    SELECT CASE WHEN o_totalprice > 0 AND o_totalprice <= 100000 THEN 'Small'
                WHEN o_totalprice > 100000 AND o_totalprice <= 250000 THEN 'Medium'
                WHEN o_totalprice > 250000 AND o_totalprice <= 400000 THEN 'Large'
                WHEN o_totalprice > 400000 THEN 'XLarge' END AS size, count(*) AS orders
    FROM orders GROUP BY 1
    """
)
def bin_cut(spark, sf_dir):
    size = C.cut("o_totalprice", [0, 100000, 250000, 400000, float("inf")], ["Small", "Medium", "Large", "XLarge"])
    return table(spark, sf_dir, "orders").groupBy(size.alias("size")).agg(F.count("*").alias("orders"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus END AS status FROM orders")
def categorical(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", C.categorical("o_orderstatus", ["O", "F"]).alias("status"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_totalprice * 0.1::DOUBLE ELSE o_totalprice * 0.05::DOUBLE END AS discount
    FROM orders
    """
)
def case_discount(spark, sf_dir):
    price = F.col("o_totalprice")
    discount = F.when(price > 100000, price * 0.1).otherwise(price * 0.05)
    return table(spark, sf_dir, "orders").select("o_orderkey", discount.alias("discount"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'Premium' WHEN o_totalprice > 100000 THEN 'Standard'
           ELSE 'Basic' END AS tier
    FROM orders
    """
)
def case_tier(spark, sf_dir):
    price = F.col("o_totalprice")
    tier = F.when(price > 400000, "Premium").when(price > 100000, "Standard").otherwise("Basic")
    return table(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"))


@query(
    """
    SELECT event_type, count(k) AS parsed, CAST(sum(k) AS DOUBLE) / count(k) AS mean_k
    FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) GROUP BY event_type
    """
)
def json_props(spark, sf_dir):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    parsed = table(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return parsed.groupBy("event_type").agg(
        F.count("k").alias("parsed"), (F.sum("k").cast("double") / F.count("k")).alias("mean_k")
    )


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS number FROM customer")
def regex_extract(spark, sf_dir):
    digits = F.element_at(F.regexp_extract_all("c_name", F.lit("([0-9]+)"), 1), -1)
    return table(spark, sf_dir, "customer").select("c_custkey", digits.cast("bigint").alias("number"))


@query("SELECT doc_id, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def text_checksums(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("bigint").alias("size")
    )


# User functions


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * 0.15::DOUBLE AS discount FROM lineitem
    """
)
def udf_discount(spark, sf_dir):
    def discount(amount, rate=0.1):
        return amount * rate

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return U.apply_values(lines, "l_extendedprice", discount, "double", "discount", rate=0.15).drop("l_extendedprice")


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) || ': ' || o_orderstatus AS summary FROM orders")
def udf_row_summary(spark, sf_dir):
    def summary(frame):
        return frame["o_orderkey"].astype(str) + ": " + frame["o_orderstatus"]

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return U.apply_rows(orders, ["o_orderkey", "o_orderstatus"], summary, "string", "summary").drop("o_orderstatus")


@query(
    """
    SELECT event_id, event_type, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z_score
    FROM events WINDOW w AS (PARTITION BY event_type)
    """
)
def udf_group_zscore(spark, sf_dir):
    def standardise(frame):
        return (frame["value"] - frame["mean"]) / frame["std"]

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    stats = {"mean": F.avg("value"), "std": F.stddev_samp("value")}
    scored = U.transform_groups(events, ["event_type"], stats, standardise, ["value"], "double", "z_score")
    return scored.select("event_id", "event_type", F.round("z_score", 6).alias("z_score"))


@query("SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS price_range FROM orders GROUP BY o_custkey")
def udf_agg_range(spark, sf_dir):
    def bounds(frame):
        grouped = frame.groupby("o_custkey")["o_totalprice"]
        return grouped.agg(low="min", high="max").reset_index()

    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    merge = {"price_range": F.max("high") - F.min("low")}
    return U.aggregate_groups(orders, ["o_custkey"], bounds, "low double, high double", merge)
