"""Comparison of a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr)


def rows_in(con: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
