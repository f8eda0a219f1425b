"""Compare a Spark result with a DuckDB result, value by value."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    """A value in a form both engines share."""
    if isinstance(value, float):
        return "nan" if value != value else repr(value + 0.0)
    if isinstance(value, decimal.Decimal):
        return "decimal " + str(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, dict):
        return str({k: plain(v) for k, v in value.items()})
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return f"{type(value).__name__} {value}"


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when names, types and the multiset of rows agree."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    theirs = relation.fetchall()
    columns = sorted(spark_df.columns)
    if sorted(names) != columns:
        return [f"columns {columns} against {sorted(names)}"]
    ours = spark_df.select(*[f"`{c}`" for c in columns]).collect()
    order = [names.index(c) for c in columns]
    mine = sorted([plain(v) for v in row] for row in ours)
    other = sorted([plain(row[i]) for i in order] for row in theirs)
    problems = []
    if len(mine) != len(other):
        problems.append(f"{len(mine)} rows against {len(other)}")
    wrong = [(a, b) for a, b in zip(mine, other) if a != b]
    for a, b in wrong[:3]:
        problems.append(f"{columns}: {a} against {b}"[:600])
    if wrong:
        problems.append(f"{len(wrong)} rows differ")
    return problems
