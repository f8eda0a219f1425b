"""Reading, writing, copying and reconciling the sample tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.functions import columns as C
from tablesmith.operators import integrity as I
from tablesmith.operators import reconcile as V
from tablesmith.plans.registry import query, table
from tablesmith.session import scratch_path
from tablesmith.sources import folders, isolation, paths, readers, writers
from tablesmith.streaming.incremental import copy_new_files

_ORDERS_SCHEMA = (
    "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string"
)
_TOTALS = """count(*) AS rows, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
             CAST(max(o_orderdate) AS DATE) AS latest"""


def _order_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("o_orderpriority").agg(
        F.count("*").alias("rows"), C.exact_sum("o_totalprice").alias("total"),
        F.max("o_orderdate").cast("date").alias("latest"),
    )


# Reading and writing


@query(f"SELECT o_orderpriority, {_TOTALS} FROM orders GROUP BY o_orderpriority")
def csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "csv")
    writers.write_csv(table(spark, sf_dir, "orders"), path, sep="|")
    return _order_totals(readers.read_csv(spark, path, _ORDERS_SCHEMA, sep="|"))


@query(
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW') THEN o_orderpriority END AS o_orderpriority,
           o_totalprice
    FROM orders
    """
)
def null_tokens(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    writers.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    schema = "o_orderkey bigint, o_orderpriority string, o_totalprice double"
    return readers.read_csv(spark, path, schema, na_values=["4-NOT SPECIFIED", "5-LOW"])


@query("SELECT o_orderkey, o_custkey FROM orders")
def parquet_projection(spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_custkey"])


@query(f"SELECT o_orderpriority, {_TOTALS} FROM orders GROUP BY o_orderpriority")
def json_lines_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "json")
    writers.write_json(table(spark, sf_dir, "orders"), path)
    return _order_totals(readers.read_json(spark, path, lines=True, schema=_ORDERS_SCHEMA))


@query(
    """
    SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)
    """
)
def csv_write_options(spark, sf_dir):
    """Quotes, separators and null marks survive a round trip in another character set."""
    path = scratch_path(spark, "options")
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    rows = rows.select("doc_id", F.concat(F.lit('a;"'), "lang").alias("marked"), "quality")
    writers.write_csv(
        rows, path, sep=";", encoding="latin-1", escapechar="\\", na_rep="NA", compression="gzip", lineterminator="\r\n"
    )
    schema = "doc_id bigint, marked string, quality int"
    read = readers.read_csv(spark, path, schema, sep=";", encoding="latin-1", escapechar="\\", na_values=["NA"])
    return read.select("doc_id", F.replace("marked", F.lit('a;"'), F.lit("")).alias("lang"), "quality")


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_documents(spark, sf_dir):
    """Texts with quotes, blanks and line ends come back as they were."""
    path, rows = scratch_path(spark, "csv-documents"), table(spark, sf_dir, "documents")
    writers.write_csv(rows, path)
    return readers.read_csv(spark, path, rows.schema)


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def json_documents(spark, sf_dir):
    """Long lines are found to be JSON lines and read whole."""
    path, rows = scratch_path(spark, "json-documents"), table(spark, sf_dir, "documents")
    writers.write_json(rows, path)
    return readers.load(spark, path, schema=rows.schema)


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n_chars FROM documents")
def bad_cells(spark, sf_dir):
    """Cells that don't fit the type, read leniently."""
    path = scratch_path(spark, "bad-cells")
    broken = F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("n_chars").cast("string"))
    writers.write_csv(table(spark, sf_dir, "documents").select("doc_id", broken.alias("n_chars")), path)
    return readers.read_csv(spark, path, "doc_id bigint, n_chars bigint", bad_rows="null")


@query(
    """
    SELECT file, rows, bad AS bad_rows, CASE WHEN bad > 0 THEN 'error' ELSE 'success' END AS status
    FROM (
        SELECT 'event_type=' || event_type AS file, count(*) AS rows,
            count(*) FILTER (WHERE event_type LIKE '%c%' AND event_id % 97 = 0) AS bad
        FROM events GROUP BY event_type
    )
    """
)
def folder_outcomes(spark, sf_dir):
    """A folder of good and broken files, read with its broken records kept, and what became of each file."""
    path, events = scratch_path(spark, "outcomes"), table(spark, sf_dir, "events")
    broken = (F.col("event_type").contains("c")) & (F.col("event_id") % 97 == 0)
    line = F.to_json(F.struct("event_id", "user_id"))
    lines = events.select("event_type", F.when(broken, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    lines.repartition("event_type").write.partitionBy("event_type").text(path)
    return folders.json_outcomes(spark, path, "event_id bigint, user_id bigint", ["event_type"]).drop("message")


def _mixed_folder(spark, sf_dir) -> str:
    """Events in files of all formats, a folder for each type of event and form: whole ones, and ones broken in ways of their own."""
    path, events = scratch_path(spark, "mixed"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    whole = events.repartition(3, "event_id")
    whole.where("event_type = 'click'").write.parquet(f"{path}/click-parquet")
    writers.write_csv(whole.where("event_type = 'view'"), f"{path}/view-csv", compression="gzip")
    writers.write_json(whole.where("event_type = 'signup'"), f"{path}/signup-json")
    # a cell that is no number in every fifth row
    bad = events.where("event_type = 'error'").withColumn("value", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")))
    writers.write_csv(bad.coalesce(1), f"{path}/error-csv")
    # a file cut in half and one with a byte that is no UTF-8, from the bytes of whole ones
    source = scratch_path(spark, "source")
    bought = events.where("event_type = 'purchase'")
    bought.coalesce(1).write.parquet(f"{source}/purchase-parquet")
    writers.write_csv(bought.coalesce(1), f"{source}/purchase-csv")
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(source)
    cut = F.col("path").endswith(".parquet")
    broken = content.select(
        F.when(cut, "purchase-parquet/cut.parquet").otherwise("purchase-csv/bytes.csv").alias("path"),
        F.when(cut, F.substring("content", F.lit(1), (F.length("content") / 2).cast("int"))).otherwise(F.concat("content", F.unhex(F.lit("FF0A")))).alias("content"),
    )
    I.write_files(broken, path)
    return path


_MIXED = "event_id bigint, user_id bigint, event_type string, value double"


@query("SELECT event_id, user_id, event_type, value FROM events WHERE event_type IN ('click', 'view', 'signup')")
def folder_good_rows(spark, sf_dir):
    """The rows of the good files of a folder of all formats, some of whose files are broken."""
    return isolation.read_folder(spark, _mixed_folder(spark, sf_dir), _MIXED)[0].drop("path")


@query(
    """
    WITH t AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_id % 5 = 0) AS bad FROM events GROUP BY event_type)
    SELECT 'click-parquet' AS folder, 'parquet' AS kind, n AS rows, 0::BIGINT AS bad_rows, NULL AS message, 'success' AS status FROM t WHERE event_type = 'click'
    UNION ALL SELECT 'view-csv', 'csv', n, 0, NULL, 'success' FROM t WHERE event_type = 'view'
    UNION ALL SELECT 'signup-json', 'json', n, 0, NULL, 'success' FROM t WHERE event_type = 'signup'
    UNION ALL SELECT 'error-csv', 'csv', n, bad, 'broken record', 'error' FROM t WHERE event_type = 'error'
    UNION ALL SELECT 'purchase-parquet', 'parquet', 0, 0, 'not readable: ArrowInvalid', 'error' FROM t WHERE event_type = 'purchase'
    UNION ALL SELECT 'purchase-csv', 'csv', n + 1, 1, 'invalid UTF-8', 'error' FROM t WHERE event_type = 'purchase'
    """
)
def folder_all_outcomes(spark, sf_dir):
    """What became of the files of a folder of all formats, added up by folder."""
    found = isolation.read_folder(spark, _mixed_folder(spark, sf_dir), _MIXED)[1]
    return found.groupBy(F.substring_index("path", "/", 1).alias("folder"), "kind", "message", "status").agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows"))


@query("SELECT * FROM orders")
def parquet_write(spark, sf_dir):
    """A partitioned write, read back whole."""
    path = scratch_path(spark, "parquet")
    orders = table(spark, sf_dir, "orders")
    writers.write_parquet(orders, path, compression="gzip", partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select(*orders.columns)


@query("SELECT *, CAST(2 AS BIGINT) AS copies FROM customer")
def write_append(spark, sf_dir):
    path = scratch_path(spark, "append")
    customers = table(spark, sf_dir, "customer")
    writers.write_parquet(customers, path)
    writers.write_parquet(customers, path, mode="a")
    return spark.read.parquet(path).groupBy(*customers.columns).agg(F.count("*").alias("copies"))


_PATH = "regexp_replace(url, '^https?://[^/?#]*', '/mnt/old')"


@query(
    f"""
    SELECT page_id, CASE WHEN p LIKE '/mnt/old/fr/%' OR p = '/mnt/old/fr' THEN '/mnt/french' || substr(p, 12)
           WHEN p LIKE '/mnt/old/%' OR p = '/mnt/old' THEN '/lake/new' || substr(p, 9)
           WHEN p LIKE '/mnt/%' OR p = '/mnt' THEN '/lake' || substr(p, 5) ELSE p END AS path,
           p LIKE '/mnt/%' AS is_mount
    FROM (SELECT page_id, {_PATH} AS p FROM pages)
    """
)
def path_mapping(spark, sf_dir):
    old = F.regexp_replace("url", "^https?://[^/?#]*", "/mnt/old")
    mapping = {"/mnt": "/lake", "/mnt/old": "/lake/new", "/mnt/old/fr": "/mnt/french"}
    return table(spark, sf_dir, "pages").select(
        "page_id", paths.map_paths(old, mapping).alias("path"), paths.is_mount(old).alias("is_mount")
    )


@query(
    """
    SELECT 'customer' AS name, count(*) AS rows, count(DISTINCT c_custkey) AS keys FROM customer
    UNION ALL SELECT 'supplier', count(*), count(DISTINCT s_suppkey) FROM supplier
    UNION ALL SELECT 'nation', count(*), count(DISTINCT n_nationkey) FROM nation
    """
)
def named_tables(spark, sf_dir):
    """Several tables written by name into one folder, and each read back."""
    path, keys = scratch_path(spark, "tables"), {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}
    writers.write_tables({name: table(spark, sf_dir, name) for name in keys}, path)
    read = [readers.read_parquet(spark, f"{path}/{name}").agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys")).select(F.lit(name).alias("name"), "rows", "keys") for name, key in keys.items()]
    return functools.reduce(DataFrame.unionByName, read)


@query("SELECT least(count(*), 100) AS rows, true AS whole FROM orders")
def row_limit(spark, sf_dir):
    """The first hundred rows of a CSV file: a limit that was asked for."""
    path, orders = scratch_path(spark, "limit"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    writers.write_csv(orders, path)
    some = readers.read_csv(spark, path, "o_orderkey bigint, o_custkey bigint", nrows=100)
    known = some.join(orders, ["o_orderkey", "o_custkey"], "left_anti").agg(F.count("*").alias("n"))
    return some.agg(F.count("*").alias("rows")).crossJoin(known).select("rows", (F.col("n") == 0).alias("whole"))


@query("SELECT count(*) AS rows, CAST(sum(CAST(value AS DECIMAL(18,2)) * 2) AS DOUBLE) AS processed FROM events")
def chunked_transform(spark, sf_dir):
    """What a chunk loop does: a derived column, written in bounded files, then totalled."""
    path = scratch_path(spark, "chunks")
    events = table(spark, sf_dir, "events").withColumn("processed", C.exact("value") * 2)
    writers.write_parquet(events, path, rows_per_file=50_000)
    written = spark.read.parquet(path)
    return written.agg(F.count("*").alias("rows"), F.sum("processed").cast("double").alias("processed"))


@query(
    """
    SELECT count(*) AS files, count(*) FILTER (WHERE bad = 0) AS successful, count(*) FILTER (WHERE bad > 0) AS failed
    FROM (SELECT user_id, count(*) FILTER (WHERE event_id % 97 = 0) AS bad FROM events GROUP BY user_id)
    """
)
def outcome_summary(spark, sf_dir):
    """Each user's events stand for a file; some rows are cut off and fail to parse."""
    props = F.when(F.col("event_id") % 97 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    rows = table(spark, sf_dir, "events").select("user_id", props.alias("props"))
    error = F.when(F.try_parse_json("props").isNull(), F.lit("not JSON"))
    return folders.outcome_totals(folders.file_outcomes(rows, "user_id", error))


# Reconciliation


def _edited(orders: DataFrame, doubled: bool) -> DataFrame:
    """A copy of the orders with rows removed, repriced and, if asked, doubled."""
    key = F.col("o_orderkey")
    price = F.when(key % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    edited = orders.where(key % 100 != 0).withColumn("o_totalprice", price)
    return edited.unionAll(edited.where(key % 103 == 0)) if doubled else edited


_KEPT = """SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
                  o_orderdate, o_orderpriority
           FROM orders WHERE o_orderkey % 100 <> 0"""
_DOUBLED = f"({_KEPT} UNION ALL SELECT * FROM ({_KEPT}) WHERE o_orderkey % 103 = 0)"


@query(
    f"""
    SELECT (SELECT count(*) FROM orders) AS source_rows, (SELECT count(*) FROM {_DOUBLED}) AS target_rows,
           (SELECT count(*) FROM orders) = (SELECT count(*) FROM {_DOUBLED}) AS row_count_match
    """
)
def recon_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.row_counts(orders, _edited(orders, True))


@query(
    f"""
    SELECT *, count(*) AS difference FROM (SELECT * FROM orders EXCEPT ALL SELECT * FROM {_DOUBLED}) GROUP BY ALL
    UNION ALL
    SELECT *, -count(*) FROM (SELECT * FROM {_DOUBLED} EXCEPT ALL SELECT * FROM orders) GROUP BY ALL
    """
)
def recon_row_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.row_diff(orders, _edited(orders, True))


@query(
    f"""
    SELECT o_orderkey, 'missing' AS change, NULL AS "column", NULL AS source, NULL AS target FROM orders WHERE o_orderkey % 100 = 0
    UNION ALL
    SELECT s.o_orderkey, 'changed', 'o_totalprice', CAST(s.o_totalprice AS VARCHAR), CAST(t.o_totalprice AS VARCHAR)
    FROM orders s JOIN ({_KEPT}) t ON s.o_orderkey = t.o_orderkey WHERE s.o_totalprice <> t.o_totalprice
    """
)
def recon_keyed_diff(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.keyed_diff(orders, _edited(orders, False), ["o_orderkey"])


@query(
    f"""
    SELECT o_orderkey, 'missing' AS change, NULL AS "column", NULL AS source, NULL AS target FROM orders WHERE o_orderkey % 100 = 0
    UNION ALL
    SELECT s.o_orderkey, 'changed', 'o_totalprice', CAST(s.o_totalprice AS VARCHAR), CAST(t.o_totalprice AS VARCHAR)
    FROM orders s JOIN ({_KEPT}) t ON s.o_orderkey = t.o_orderkey WHERE s.o_totalprice <> t.o_totalprice
    """
)
def recon_bucket_diff(spark, sf_dir):
    """The cells that differ, sought only in buckets of keys whose digests differ."""
    orders = table(spark, sf_dir, "orders")
    return V.bucket_diff(orders, _edited(orders, False), ["o_orderkey"])


@query("SELECT true AS row_count_match, false AS schema_match, CAST(1 AS BIGINT) AS data_discrepancies FROM orders LIMIT 1")
def recon_other_columns(spark, sf_dir):
    """A copy that lacks a column but no row."""
    orders = table(spark, sf_dir, "orders")
    return V.summary(V.issues(orders, orders.drop("o_orderpriority")))


_ONLY = "CAST((SELECT count(*) FROM (SELECT * FROM {} EXCEPT ALL SELECT * FROM {})) AS VARCHAR)"
_ISSUES = f"""(
    SELECT 'row_count' AS type, CAST((SELECT count(*) FROM orders) AS VARCHAR) AS source,
           CAST((SELECT count(*) FROM {_DOUBLED}) AS VARCHAR) AS target, 'HIGH' AS severity
    WHERE (SELECT count(*) FROM orders) <> (SELECT count(*) FROM {_DOUBLED})
    UNION ALL
    SELECT 'rows', {_ONLY.format("orders", _DOUBLED)}, {_ONLY.format(_DOUBLED, "orders")}, 'HIGH')"""


@query(f"SELECT * FROM {_ISSUES}")
def recon_issues(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.issues(orders, _edited(orders, True))


@query(
    f"""
    SELECT count(*) FILTER (WHERE type = 'row_count') = 0 AS row_count_match,
           count(*) FILTER (WHERE type = 'schema') = 0 AS schema_match, count(*) AS data_discrepancies
    FROM {_ISSUES}
    """
)
def recon_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.summary(V.issues(orders, _edited(orders, True)))


_SAMPLED = "CAST('0x' || left(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) % 100 < 10"


@query(
    f"""
    SELECT o_orderkey, 'missing' AS change, NULL AS "column", NULL AS source, NULL AS target FROM orders
    WHERE o_orderkey % 100 = 0 AND {_SAMPLED}
    UNION ALL
    SELECT o_orderkey, 'changed', 'o_totalprice', CAST(o_totalprice AS VARCHAR), CAST(o_totalprice + 1 AS VARCHAR)
    FROM orders WHERE o_orderkey % 100 <> 0 AND o_orderkey % 101 = 0 AND {_SAMPLED}
    """
)
def recon_sampled(spark, sf_dir):
    """Cell changes among a tenth of the keys, the same keys on both sides though one has them as text."""
    orders = table(spark, sf_dir, "orders")
    other = _edited(orders, False).withColumn("o_orderkey", F.col("o_orderkey").cast("string"))
    sides = [V.key_sample(side, ["o_orderkey"], 10) for side in (orders, other)]
    return V.keyed_diff(*sides, ["o_orderkey"]).withColumn("o_orderkey", F.col("o_orderkey").cast("bigint"))


@query("SELECT * FROM (VALUES ('o_comment', 'missing_in_source', NULL, 'string'), ('o_custkey', 'type_changed', 'bigint', 'string'), ('o_orderpriority', 'missing_in_target', 'string', NULL)) AS t(\"column\", issue, source, target) WHERE (SELECT count(*) FROM orders) > 0")
def recon_schema_diff(spark, sf_dir):
    """Columns lost, gained and changed between the orders and an altered copy."""
    orders = table(spark, sf_dir, "orders")
    altered = orders.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_comment", F.lit("").cast("string"))
    return V.schema_diff(orders, altered).where("issue <> 'nullability_changed'")


@query(
    """
    SELECT 'row_count' AS type, CAST(count(*) AS VARCHAR) AS source, CAST(count(*) FILTER (WHERE o_orderkey % 100 <> 0) AS VARCHAR) AS target, 'HIGH' AS severity FROM orders
    UNION ALL SELECT 'type', 'o_custkey bigint', 'o_custkey string', 'HIGH'
    UNION ALL SELECT 'rows', CAST(count(*) FILTER (WHERE o_orderkey % 100 = 0) AS VARCHAR), '0', 'HIGH' FROM orders
    """
)
def recon_changed_types(spark, sf_dir):
    """A column that turned to text is an issue, and its rows are still compared."""
    orders = table(spark, sf_dir, "orders")
    return V.issues(orders, orders.where("o_orderkey % 100 <> 0").withColumn("o_custkey", F.col("o_custkey").cast("string")))


@query(
    """
    SELECT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE doc_id END AS doc_id, 'changed' AS change, 'lang' AS "column", lang AS source, upper(lang) AS target
    FROM documents WHERE doc_id = 0 OR (doc_id % 10 <> 0 AND doc_id % 3 = 0)
    """
)
def recon_null_keys(spark, sf_dir):
    """One row with a null key meets its like on the other side."""
    docs = table(spark, sf_dir, "documents").where("doc_id = 0 OR doc_id % 10 <> 0").select("doc_id", "lang")
    key = F.when(F.col("doc_id") % 10 != 0, F.col("doc_id")).alias("doc_id")
    changed = F.when(F.col("doc_id") % 3 == 0, F.upper("lang")).otherwise(F.col("lang")).alias("lang")
    return V.keyed_diff(docs.select(key, "lang"), docs.select(key, changed), ["doc_id"])


def _quality_sql(source: str, name: str) -> str:
    return f"""
    SELECT 'completeness' AS "check", 'o_orderpriority' AS name, count(o_orderpriority) / count(*) AS {name} FROM {source}
    UNION ALL SELECT 'uniqueness', 'o_orderkey', count(DISTINCT o_orderkey) / count(o_orderkey) FROM {source}
    UNION ALL SELECT 'consistency', 'price above zero', count(*) FILTER (WHERE o_totalprice > 1000) / count(*) FROM {source}"""


@query(
    f"""
    SELECT "check", name, source, target FROM ({_quality_sql("orders", "source")})
    JOIN ({_quality_sql(_DOUBLED, "target")}) USING ("check", name)
    """
)
def recon_quality(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rules = {"price above zero": F.col("o_totalprice") > 1000}
    return V.quality_issues(orders, _edited(orders, True), ["o_orderpriority"], ["o_orderkey"], rules)


# Copies


@query(
    """
    SELECT coalesce(s.page_id, t.page_id) AS page_id, source_size, source_sha256, target_size, target_sha256,
           CASE WHEN t.page_id IS NULL THEN 'missing' WHEN s.page_id IS NULL THEN 'extra'
                WHEN source_size <> target_size THEN 'size_differs'
                WHEN source_sha256 <> target_sha256 THEN 'hash_differs' ELSE 'ok' END AS status
    FROM (SELECT page_id, CAST(strlen(html) AS BIGINT) AS source_size, sha256(html) AS source_sha256 FROM pages WHERE page_id % 11 <> 0) s
    FULL JOIN (SELECT page_id, CAST(strlen(h) AS BIGINT) AS target_size, sha256(h) AS target_sha256
               FROM (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN html || ' ' WHEN page_id % 3 = 0 THEN 'x' || substr(html, 2) ELSE html END AS h
                     FROM pages WHERE page_id % 7 <> 0)) t
    ON s.page_id = t.page_id
    """
)
def manifest_diff(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    key = F.col("page_id")
    html = (
        F.when(key % 5 == 0, F.concat("html", F.lit(" ")))
        .when(key % 3 == 0, F.concat(F.lit("x"), F.expr("substring(html, 2)")))
        .otherwise(F.col("html"))
    )

    def sums(rows):
        return rows.select("page_id", F.octet_length("html").cast("bigint").alias("size"), F.sha2("html", 256).alias("sha256"))

    edited = pages.where(key % 7 != 0).withColumn("html", html)
    return I.compare_checksums(sums(pages.where(key % 11 != 0)), sums(edited), ["page_id"])


@query()
def file_checksums(spark, sf_dir):
    """SHA-256 of the table files themselves; the other engine sees tables, not files."""
    return I.file_checksums(spark, sf_dir, "*.parquet")


@query("SELECT count(*) AS rows, count(*) AS copied_rows, true AS matches FROM lineitem")
def table_copy(spark, sf_dir):
    return I.copy_table(table(spark, sf_dir, "lineitem"), scratch_path(spark, "copy"))


@query(
    """
    SELECT count(*) AS rows, CAST(CAST(sum(CAST(CAST('0x' || left(sha256(
        coalesce('+' || length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') || coalesce('+' || length(lang) || ':' || lang, '-')
        || coalesce('+' || length(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || coalesce('+' || length(source) || ':' || source, '-')
        || coalesce('+' || length(text) || ':' || text, '-')), 15) AS BIGINT) AS HUGEINT)) AS HUGEINT) AS VARCHAR) AS fingerprint
    FROM documents
    """
)
def table_fingerprint(spark, sf_dir):
    """Rows and digest sum of a table."""
    return I.fingerprint(table(spark, sf_dir, "documents"))


@query("SELECT count(*) AS rows, count(*) AS copied_rows, true AS matches FROM events WHERE value IS NOT NULL")
def nested_copy(spark, sf_dir):
    """A copy of rows with a map, an array and a struct, compared by what they hold."""
    events = table(spark, sf_dir, "events").where("value IS NOT NULL")
    nested = events.select("event_id", F.create_map("event_type", "value").alias("by_type"), F.array("user_id", "event_id").alias("ids"), F.struct("ts", "props").alias("rest"))
    return I.copy_table(nested, scratch_path(spark, "nested"))


@query("SELECT count(*) AS pairs, count(*) FILTER (WHERE lang IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL) AS told_apart FROM documents")
def fingerprint_of_cut_values(spark, sf_dir):
    """Rows whose values are cut at another place have another fingerprint, though they read alike when put together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    mark = F.lit("\u001f+")
    one = docs.select("doc_id", F.concat("lang", mark, "source").alias("a"), F.col("text").alias("b"))
    other = docs.select("doc_id", F.col("lang").alias("a"), F.concat("source", mark, "text").alias("b"))
    digests = [t.groupBy("doc_id").agg(*I.quick_digest(t)).select("doc_id", F.col("digest1").alias(n)) for t, n in ((one, "x"), (other, "y"))]
    both = digests[0].join(digests[1], "doc_id")
    return both.agg(F.count("*").alias("pairs"), F.count_if(F.col("x") != F.col("y")).alias("told_apart"))


@query(
    """
    SELECT 'texts/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, CAST(1 AS BIGINT) AS ranges,
        sha256(unhex(sha256(coalesce(text, '')))) AS tree_sha256
    FROM documents
    """
)
def file_tree_checksums(spark, sf_dir):
    """Every document as a file, and the tree digests of the files, hashed in ranges."""
    path = scratch_path(spark, "texts")
    name = F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    I.write_files(table(spark, sf_dir, "documents").select(name, F.col("text").cast("binary").alias("content")), path)
    return I.tree_checksums(spark, path)


@query("SELECT DISTINCT '_' || lang || '.bin' AS path, CAST(2 AS BIGINT) AS size, sha256(lang) AS sha256, 'ok' AS status FROM documents")
def copy_files(spark, sf_dir):
    """Files with hidden names, one per language, copied and compared with what was to be written."""
    source, target = scratch_path(spark, "files"), scratch_path(spark, "files-copy")
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    I.write_files(langs.select(F.concat(F.lit("_"), "lang", F.lit(".bin")).alias("path"), F.col("lang").cast("binary").alias("content")), source)
    checked = I.copy_and_verify(spark, source, target, scratch_path(spark, "manifest"))
    return checked.select("path", F.col("target_size").alias("size"), F.col("target_sha256").alias("sha256"), "status")


@query(
    """
    SELECT event_id, ts, event_type FROM events
    WHERE event_id NOT IN (SELECT event_id FROM events WHERE ts < (SELECT min(ts) + INTERVAL 5 DAY FROM events))
    """
)
def incremental_delta(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    start = events.agg(F.min("ts").alias("first")).select(F.expr("first + INTERVAL 5 DAYS")).scalar()
    return I.new_rows(events, events.where(F.col("ts") < start), ["event_id"])


@query(
    """
    SELECT CAST(doc_id AS VARCHAR) || '.txt' AS path, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 1 THEN 'changed' ELSE 'same' END AS change,
        sha256(coalesce(text, '') || CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 1 THEN '!' ELSE '' END) AS sha256,
        sha256(coalesce(text, '') || CASE WHEN doc_id % 3 <> 0 AND doc_id % 7 = 1 THEN '!' ELSE '' END) AS arrived, 'same' AS later
    FROM documents
    """
)
def incremental_changes(spark, sf_dir):
    """A folder copied again after files came and others were rewritten under their names; a third run finds nothing to do."""
    source, target, manifest = (scratch_path(spark, name) for name in ("living", "mirror", "versions"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path, late = F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id") % 3 == 0
    I.write_files(docs.where(~late).select(path, F.col("text").cast("binary").alias("content")), source)
    I.sync_folder(spark, source, target, manifest)
    I.write_files(docs.where(late).select(path, F.col("text").cast("binary").alias("content")), source)
    I.write_files(docs.where(~late & (F.col("doc_id") % 7 == 1)).select(path, F.concat("text", F.lit("!")).cast("binary").alias("content")), source)
    second = I.sync_folder(spark, source, target, manifest)
    third = I.sync_folder(spark, source, target, manifest).select("path", F.col("change").alias("later"))
    arrived = I.file_checksums(spark, target).select("path", F.col("sha256").alias("arrived"))
    return second.join(arrived, "path", "left").join(third, "path", "left").select("path", "change", "sha256", "arrived", "later")


@query("SELECT * FROM events")
def incremental_copy(spark, sf_dir):
    """The event files copied by a stream that ends when no file is left; a second run adds nothing."""
    target, state = scratch_path(spark, "stream"), scratch_path(spark, "state")
    schema = table(spark, sf_dir, "events").schema
    for _ in range(2):
        copy_new_files(spark, sf_dir, target, state, schema, pattern="events.parquet")
    return spark.read.schema(schema).parquet(target)
