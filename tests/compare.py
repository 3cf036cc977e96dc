"""Spark results against SQL over the same tables."""

from __future__ import annotations

import os

import duckdb


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 2})
    for f in os.listdir(folder):
        con.sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return con


def rows(values) -> list[tuple]:
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in values)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def assert_same(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == dict(zip(rel.columns, map(str, rel.types)))
    want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
    assert rows(got) == rows(want)
