"""Run a registered query in Spark and its oracle in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

from eligra.plans.views import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(names)}"
    expected, got = rows_of(names, relation.fetchall()), rows_of(spark_df.columns, spark_df.collect())
    if expected == got:
        return None
    extra, missing = got - expected, expected - got
    return (f"rows {sum(got.values())} vs {sum(expected.values())}; only in Spark {sum(extra.values())}: {list(extra)[:3]}; "
            f"only in SQL {sum(missing.values())}: {list(missing)[:3]}")
