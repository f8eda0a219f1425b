"""Joins, aggregates, pivots, windows and cleaning over the sample tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import relational as R
from tablesmith.operators import windows as W
from tablesmith.plans.registry import query, table

# The categories the pivots spread over.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]
PREMIUM = ["AUTOMOBILE", "BUILDING"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _pivot_sql(values: list[str], column: str, amount: str, suffix: str = "", default: str | None = None) -> str:
    """One filtered sum per value, as SQL select items."""
    items = []
    for value in values:
        total = f"CAST(sum(CAST({amount} AS DECIMAL(18,2))) FILTER (WHERE {column} = '{value}') AS DOUBLE)"
        total = f"coalesce({total}, {default})" if default else total
        items.append(f'{total} AS "{value}{suffix}"')
    return ", ".join(items)


def _lines_per_order(lineitem: DataFrame) -> DataFrame:
    """Line totals per order; counting here shrinks a hot order before any join."""
    return lineitem.groupBy("l_orderkey").agg(
        F.sum(C.exact("l_extendedprice")).alias("revenue"),
        F.sum("l_quantity").alias("quantity"),
        F.count("*").alias("lines"),
    )


@query(
    """
    SELECT r_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           avg(l_quantity) AS avg_quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name ORDER BY revenue DESC
    """
)
def region_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, join, group, aggregate, sort. Sums move up key by key, so no join sees a hot key."""
    sums = [F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"), F.sum("lines").alias("lines")]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    per_customer = (
        _lines_per_order(table(spark, sf_dir, "lineitem"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey")
        .agg(*sums)
    )
    per_nation = per_customer.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(*sums)
    named = per_nation.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    by_region = named.groupBy("r_name").agg(*sums)
    result = by_region.select(
        "r_name",
        F.col("revenue").cast("double").alias("revenue"),
        (F.col("quantity") / F.col("lines")).alias("avg_quantity"),
    )
    return R.sort_values(result, ["revenue"], ascending=False)


# Projection and filters


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def project_columns(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CAST(CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS line_total
    FROM lineitem
    """
)
def derived_line_total(spark, sf_dir):
    total = (C.exact("l_quantity") * C.exact("l_extendedprice")).cast("double")
    return table(spark, sf_dir, "lineitem").select(*LINE_KEY, total.alias("line_total"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000")
def filter_high_value(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(F.col("o_totalprice") > 400000).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
    FROM lineitem WHERE l_extendedprice > 50000 AND l_quantity > 30
    """
)
def filter_and(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.where((F.col("l_extendedprice") > 50000) & (F.col("l_quantity") > 30)).select(
        *LINE_KEY, "l_quantity", "l_extendedprice"
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_isin(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query(
    """
    SELECT c_custkey, coalesce(seg IN ('AUTOMOBILE', 'BUILDING'), false) AS is_premium
    FROM (SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS seg FROM customer)
    """
)
def flag_isin(spark, sf_dir):
    segment = F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE"))
    return table(spark, sf_dir, "customer").select("c_custkey", C.is_in(segment, PREMIUM).alias("is_premium"))


# Joins


def _customers(spark, sf_dir, *extra: str) -> DataFrame:
    named = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        *extra,
    )
    return named


def _orders(spark, sf_dir, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("amount"), *extra,
    )


@query(
    """
    SELECT o_custkey AS customer_id, o_orderkey AS order_id, o_totalprice AS amount, c_name AS name,
           c_mktsegment AS segment
    FROM orders JOIN customer ON o_custkey = c_custkey
    """
)
def join_inner(spark, sf_dir):
    return R.merge(_orders(spark, sf_dir), _customers(spark, sf_dir), on="customer_id")


def _partial_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """All orders and all customers with doubled keys, so both sides miss partners."""
    customers = _customers(spark, sf_dir).withColumn("customer_id", F.col("customer_id") * 2)
    return _orders(spark, sf_dir).drop("amount"), customers


@query(
    """
    SELECT o_custkey AS customer_id, o_orderkey AS order_id, c_name AS name, c_mktsegment AS segment
    FROM orders LEFT JOIN customer ON o_custkey = 2 * c_custkey
    """
)
def join_left(spark, sf_dir):
    orders, customers = _partial_sides(spark, sf_dir)
    return R.merge(orders, customers, on="customer_id", how="left")


@query(
    """
    SELECT coalesce(o_custkey, 2 * c_custkey) AS customer_id, o_orderkey AS order_id, c_name AS name,
           c_mktsegment AS segment
    FROM orders FULL JOIN customer ON o_custkey = 2 * c_custkey
    """
)
def join_outer(spark, sf_dir):
    orders, customers = _partial_sides(spark, sf_dir)
    return R.merge(orders, customers, on="customer_id", how="outer")


@query(
    """
    SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_name AS name, l_partkey AS product_id,
           l_suppkey AS supplier_id, l_linenumber AS line, p_name AS product
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
         JOIN part ON l_partkey = p_partkey
    """
)
def join_multi(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("supplier_id"), F.col("l_linenumber").alias("line"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product"))
    orders = _orders(spark, sf_dir).drop("amount")
    customers = _customers(spark, sf_dir).drop("segment")
    buyers = R.merge(orders, customers, on="customer_id")
    products = R.merge(lines, parts, on="product_id")
    return R.merge(products, buyers, on="order_id")


@query(
    """
    SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey
    """
)
def join_diff_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return R.merge(orders, customers, left_on="o_custkey", right_on="c_custkey")


@query(
    """
    SELECT l_partkey AS product_id, l_orderkey AS order_id, l_linenumber AS line, l_suppkey AS supplier_id,
           l_extendedprice AS price_order, p_retailprice AS price_product
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    """
)
def join_suffixes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product_id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supplier_id"),
        F.col("l_extendedprice").alias("price"),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_retailprice").alias("price"))
    return R.merge(lines, parts, on="product_id", how="left", suffixes=("_order", "_product"))


# Aggregates


@query("SELECT o_custkey, count(*) AS size FROM orders GROUP BY o_custkey")
def group_size(spark, sf_dir):
    return R.group_by(table(spark, sf_dir, "orders"), "o_custkey").agg(F.count("*").alias("size"))


@query(
    """
    SELECT l_returnflag, l_linestatus,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
           CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS discount,
           CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def group_sum_multi(spark, sf_dir):
    return R.group_by(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").agg(
        C.exact_sum("l_quantity").alias("quantity"),
        C.exact_sum("l_extendedprice").alias("price"),
        C.exact_sum("l_discount").alias("discount"),
        C.exact_sum("l_tax").alias("tax"),
    )


@query(
    """
    SELECT o_custkey AS customer_id, count(o_orderkey) AS order_count,
           CAST(round_even(CAST(sum(a) AS DECIMAL(28,8)), 2) AS DOUBLE) AS total_spend,
           CAST(round_even(CAST(CAST(sum(a) AS DOUBLE) / count(a) AS DECIMAL(28,8)), 2) AS DOUBLE) AS avg_order_value,
           max(o_totalprice) AS max_order_value,
           CAST(round_even(CAST(sum(t) AS DECIMAL(28,8)), 2) AS DOUBLE) AS total_items,
           max(coalesce(c_mktsegment IN ('AUTOMOBILE', 'BUILDING'), false)) AS is_premium,
           min(c_name) AS name
    FROM (SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS a,
                 CAST(l_quantity AS DECIMAL(18,2)) * CAST(l_extendedprice AS DECIMAL(18,2)) AS t
          FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey)
    GROUP BY o_custkey
    """
)
def customer_summary(spark, sf_dir):
    """Per customer over order lines: an order counts once per line, once if it has none."""
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("lines"), F.sum(C.exact("l_quantity") * C.exact("l_extendedprice")).alias("items"))
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    times = F.coalesce("lines", F.lit(1))
    sums = orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(
        F.sum(times).alias("order_count"),
        F.sum(C.exact("o_totalprice") * times).alias("spend"),
        F.max("o_totalprice").alias("max_order_value"),
        F.sum("items").alias("items"),
    )
    with_names = sums.join(_customers(spark, sf_dir), "customer_id", "left")
    return with_names.select(
        "customer_id",
        "order_count",
        C.round_even("spend").alias("total_spend"),
        C.round_even(F.col("spend").cast("double") / F.col("order_count")).alias("avg_order_value"),
        "max_order_value",
        C.round_even("items").alias("total_items"),
        C.is_in("segment", PREMIUM).alias("is_premium"),
        "name",
    )


@query(
    """
    SELECT p_type AS category, count(*) AS line_count,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price,
           CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total_units
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type
    """
)
def category_summary(spark, sf_dir):
    per_part = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.sum(C.exact("l_extendedprice")).alias("price"), F.sum(C.exact("l_quantity")).alias("units")
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    joined = per_part.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price = F.sum("price").cast("double")
    return joined.groupBy(F.col("p_type").alias("category")).agg(
        F.sum("n").alias("line_count"),
        price.alias("total_revenue"),
        (price / F.sum("n")).alias("avg_price"),
        F.sum("units").cast("double").alias("total_units"),
    )


def _month(column: str):
    return F.trunc(F.col(column).cast("date"), "month")


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM orders GROUP BY 1
    """
)
def monthly_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("month")).agg(
        F.count("*").alias("orders"), C.exact_sum("o_totalprice").alias("revenue")
    )


@query(
    """
    SELECT CAST(ts AS DATE) AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean, count(value) AS n
    FROM events GROUP BY 1
    """
)
def daily_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(
        C.exact_sum("value").alias("total"), C.exact_mean("value").alias("mean"), F.count("value").alias("n")
    )


@query(
    """
    SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month,
           count(*) AS count
    FROM orders GROUP BY 1, 2
    """
)
def year_month_counts(spark, sf_dir):
    dated = table(spark, sf_dir, "orders").withColumns({"year": F.year("o_orderdate"), "month": F.month("o_orderdate")})
    return dated.groupBy("year", "month").count()


@query(
    """
    SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(o_orderkey) AS order_count,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_order,
           count(DISTINCT o_custkey) AS unique_customers
    FROM orders GROUP BY 1
    """
)
def temporal_summary(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("month")).agg(
        F.count("o_orderkey").alias("order_count"),
        C.exact_sum("o_totalprice").alias("revenue"),
        C.exact_mean("o_totalprice").alias("avg_order"),
        F.count_distinct("o_custkey").alias("unique_customers"),
    )


@query(
    """
    SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean,
           max(o_totalprice) AS highest, min(o_totalprice) AS lowest
    FROM orders
    """
)
def global_aggs(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        C.exact_sum("o_totalprice").alias("total"),
        C.exact_mean("o_totalprice").alias("mean"),
        F.max("o_totalprice").alias("highest"),
        F.min("o_totalprice").alias("lowest"),
    )


@query(
    """
    SELECT count(o_orderkey) AS count,
           CAST(round_even(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,8)), 2) AS DOUBLE) AS total,
           CAST(round_even(CAST(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS DECIMAL(28,8)), 2) AS DOUBLE) AS mean,
           CAST(round_even(CAST(stddev_samp(o_totalprice) AS DECIMAL(28,8)), 2) AS DOUBLE) AS std,
           min(o_totalprice) AS lowest, max(o_totalprice) AS highest
    FROM orders
    """
)
def summary_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(
        F.count("o_orderkey").alias("count"),
        C.round_even(F.sum(C.exact("o_totalprice"))).alias("total"),
        C.round_even(C.exact_mean("o_totalprice")).alias("mean"),
        C.round_even(F.stddev_samp("o_totalprice")).alias("std"),
        F.min("o_totalprice").alias("lowest"),
        F.max("o_totalprice").alias("highest"),
    )


@query("SELECT count(c_custkey) AS customers, count(DISTINCT c_mktsegment) AS segments FROM customer")
def custom_agg_nunique(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(
        F.count("c_custkey").alias("customers"), F.count_distinct("c_mktsegment").alias("segments")
    )


# Pivots


def _orders_by_region(spark, sf_dir) -> DataFrame:
    """Order sums per customer and status, then the region; hot customers shrink first."""
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.sum(C.exact("o_totalprice")).alias("amount")
    )
    return (
        per_customer.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )


@query(
    f"""
    SELECT r_name, {_pivot_sql(STATUSES, "o_orderstatus", "o_totalprice")}
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
         JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name
    """
)
def pivot_sum(spark, sf_dir):
    total = {"sum": F.sum("amount").cast("double")}
    return R.pivot_table(_orders_by_region(spark, sf_dir), ["r_name"], "o_orderstatus", STATUSES, total)


@query(
    f"""
    SELECT c_mktsegment, {_pivot_sql(PRIORITIES, "o_orderpriority", "o_totalprice", "_sum")},
           {", ".join(f'''nullif(count(*) FILTER (WHERE o_orderpriority = '{p}'), 0) AS "{p}_count"''' for p in PRIORITIES)}
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment
    """
)
def pivot_multi(spark, sf_dir):
    per_customer = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(
        F.sum(C.exact("o_totalprice")).alias("amount"), F.count("*").alias("n")
    )
    joined = per_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    both = {"sum": F.sum("amount").cast("double"), "count": F.sum("n")}
    return R.pivot_table(joined, ["c_mktsegment"], "o_orderpriority", PRIORITIES, both)


def _lines_with_type(spark, sf_dir) -> DataFrame:
    """Sales per order and part type. Lines per part are many, parts are unique."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", C.exact("l_extendedprice").alias("amount"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    typed = R.merge(lines, parts, on="l_partkey")
    per_order = typed.groupBy("l_orderkey", "p_type").agg(F.sum("amount").alias("amount"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


@query(
    f"""
    SELECT o_custkey, {_pivot_sql(PART_TYPES, "p_type", "l_extendedprice", default="0")}
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    GROUP BY o_custkey
    """
)
def pivot_fill(spark, sf_dir):
    total = {"sum": F.sum("amount").cast("double")}
    return R.pivot_table(_lines_with_type(spark, sf_dir), ["o_custkey"], "p_type", PART_TYPES, total, fill_value=0)


@query(
    f"""
    SELECT c_mktsegment, {_pivot_sql(PART_TYPES, "p_type", "l_extendedprice")}
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
         JOIN customer ON o_custkey = c_custkey
    GROUP BY c_mktsegment
    """
)
def crosstab_sum(spark, sf_dir):
    per_customer = _lines_with_type(spark, sf_dir).groupBy("o_custkey", "p_type").agg(F.sum("amount").alias("amount"))
    joined = per_customer.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    total = {"sum": F.sum("amount").cast("double")}
    return R.pivot_table(joined, ["c_mktsegment"], "p_type", PART_TYPES, total)


# Windows


@query(
    """
    SELECT o_orderkey, o_custkey,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
                ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cumulative_spend
    FROM orders
    """
)
def running_total(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", C.exact("o_totalprice").alias("amount"))
    summed = W.running_total(orders, "amount", ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return summed.select("o_orderkey", "o_custkey", F.col("running_total").cast("double").alias("cumulative_spend"))


@query(
    """
    SELECT o_orderkey, month, CAST(rank() OVER (PARTITION BY month ORDER BY o_totalprice DESC) AS DOUBLE)
           + (count(*) OVER (PARTITION BY month, o_totalprice) - 1) / 2 AS rank_in_month
    FROM (SELECT o_orderkey, o_totalprice, CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders)
    """
)
def rank_in_month(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", _month("o_orderdate").alias("month"))
    ranked = W.average_rank(orders, "o_totalprice", ["month"], ascending=False, name="rank_in_month")
    return ranked.drop("o_totalprice")


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           (CAST(rank() OVER (ORDER BY l_extendedprice) AS DOUBLE)
            + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2) / count(*) OVER () * 100 AS spend_percentile
    FROM lineitem
    """
)
def spend_percentile(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_extendedprice")
    return W.average_rank(lines, "l_extendedprice", percent=True, name="spend_percentile").drop("l_extendedprice")


@query(
    """
    SELECT event_id, user_id,
           round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w, 6) AS moving_avg
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)
    """
)
def moving_avg(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", C.exact("value").alias("value"))
    rolled = W.rolling_mean(events, "value", 7, ["ts", "event_id"], ["user_id"], "moving_avg")
    return rolled.select("event_id", "user_id", F.col("moving_avg").cast("double").alias("moving_avg"))


@query(
    """
    SELECT event_id,
           round(CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) / count(value) OVER w, 6) AS moving_avg
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 6 PRECEDING)
    """
)
def moving_avg_all(spark, sf_dir):
    """The same over all rows in time order; the operator cuts the order into blocks."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", C.exact("value").alias("value"))
    rolled = W.rolling_mean(events, "value", 7, ["ts", "event_id"], (), "moving_avg")
    return rolled.select("event_id", F.col("moving_avg").cast("double").alias("moving_avg"))


@query(
    """
    SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders))
           / (SELECT stddev_samp(o_totalprice) FROM orders), 6) AS z_score
    FROM orders
    """
)
def zscore(spark, sf_dir):
    scored = W.z_score(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    return scored.select("o_orderkey", F.round("z_score", 6).alias("z_score"))


_GAPS = "(SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)"


def _events_with_gaps(spark, sf_dir) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts", value.alias("value"))


@query(
    f"""
    SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
    FROM {_GAPS}
    """
)
def ffill(spark, sf_dir):
    filled = W.forward_fill(_events_with_gaps(spark, sf_dir), "value", ["ts", "event_id"], ["user_id"])
    return filled.drop("ts")


@query(
    f"""
    SELECT event_id, user_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
    FROM {_GAPS}
    """
)
def bfill(spark, sf_dir):
    filled = W.backward_fill(_events_with_gaps(spark, sf_dir), "value", ["ts", "event_id"], ["user_id"])
    return filled.drop("ts")


# Sorting, stacking, cleaning


@query(
    """
    SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer
    UNION ALL
    SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier
    """
)
def concat_tables(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
        F.lit("customer").alias("source"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source")
    )
    return R.concat([customers, suppliers])


@query(
    """
    SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
    ORDER BY o_orderdate ASC, o_totalprice DESC, o_orderkey LIMIT 25
    """
)
def sort_topk(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return R.head(orders, ["o_orderdate", "o_totalprice", "o_orderkey"], 25, [True, False, True])


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate FROM (
        SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                     ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM lineitem)
    WHERE rn = 1
    """
)
def dedup_first(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_shipdate")
    return R.keep_first(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


def _labelled(spark, sf_dir) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return R.merge(documents, table(spark, sf_dir, "labels"), on="doc_id", how="left")


_LABELLED = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"SELECT * FROM {_LABELLED} WHERE quality IS NOT NULL")
def dropna_subset(spark, sf_dir):
    return _labelled(spark, sf_dir).dropna(how="any", subset=["quality"])


@query(f"SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic FROM {_LABELLED}")
def fillna_const(spark, sf_dir):
    return _labelled(spark, sf_dir).fillna(-1, subset=["quality", "toxic"])


@query(
    f"""
    SELECT doc_id, coalesce(quality, (SELECT avg(quality) FROM {_LABELLED})) AS quality,
           coalesce(toxic, (SELECT avg(toxic) FROM {_LABELLED})) AS toxic
    FROM {_LABELLED}
    """
)
def fillna_mean(spark, sf_dir):
    return R.fill_means(_labelled(spark, sf_dir).drop("lang"), ["quality", "toxic"])


@query(
    """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Open' WHEN 'F' THEN 'Filled' ELSE o_orderstatus END AS o_orderstatus
    FROM orders
    """
)
def replace_values(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return R.replace_values(orders, "o_orderstatus", {"O": "Open", "F": "Filled"})
