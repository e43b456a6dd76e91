"""Run a registered query on Spark and its oracle SQL on DuckDB, then compare.

Same checks as the driver: column names (sorted), row count, and the multiset
of rows after normalising values (floats rounded, times as ISO text, arrays as
lists).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


STRICT = os.environ.get("TRAILSIFT_STRICT_FLOATS") == "1"


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else (v if STRICT else round(v, 6))
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    rel = con.sql(sql)
    names = rel.columns
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in rel.fetchall()]
    return [names[i] for i in order], rows


def _key(row):
    return tuple((x is None, str(type(x)), str(x)) for x in row)


_SPARK_KIND = {"bigint": "int64", "int": "int32", "smallint": "int16", "tinyint": "int8",
               "double": "float64", "float": "float32", "string": "str", "boolean": "bool",
               "timestamp_ntz": "ts", "timestamp": "ts", "date": "date"}
_DUCK_KIND = {"BIGINT": "int64", "INTEGER": "int32", "SMALLINT": "int16", "TINYINT": "int8",
              "DOUBLE": "float64", "FLOAT": "float32", "VARCHAR": "str", "BOOLEAN": "bool",
              "TIMESTAMP": "ts", "TIMESTAMP WITH TIME ZONE": "ts", "DATE": "date"}


def kinds(df, con, sql):
    s = {f.name: _SPARK_KIND.get(f.dataType.simpleString(), f.dataType.simpleString())
         for f in df.schema.fields}
    rel = con.sql(sql)
    d = {n: _DUCK_KIND.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    return s, d


def compare(df, con, sql) -> tuple[bool, str]:
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, sql)
    if s_cols != d_cols:
        return False, f"columns differ: spark={s_cols} duck={d_cols}"
    s_kind, d_kind = kinds(df, con, sql)
    differ = {c: (s_kind[c], d_kind[c]) for c in s_cols if s_kind[c] != d_kind[c]}
    if differ:
        return False, f"column types differ (spark, duck): {differ}"
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duck={len(d_rows)}"
    a, b = sorted(s_rows, key=_key), sorted(d_rows, key=_key)
    for x, y in zip(a, b):
        if x != y:
            return False, f"first differing row:\n spark={x}\n duck ={y}"
    return True, f"{len(s_rows)} rows"
