"""Compare a registered query with its reference SQL on the same tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, bool):
        return f"bool {value}"
    return repr(value)


def rows_of_sql(con, sql: str):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def rows_of_spark(df):
    names = df.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in df.collect())


def difference(spark_side, sql_side) -> str | None:
    """``None`` when equal, else a short description."""
    (a_names, a_rows), (b_names, b_rows) = spark_side, sql_side
    if a_names != b_names:
        return f"columns differ: {a_names} / {b_names}"
    if a_rows == b_rows:
        return None
    only_a = [r for r in a_rows if r not in set(b_rows)][:3]
    only_b = [r for r in b_rows if r not in set(a_rows)][:3]
    return f"rows {len(a_rows)} / {len(b_rows)}\n  spark only: {str(only_a)[:700]}\n  sql only: {str(only_b)[:700]}"
