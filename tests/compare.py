"""Queries against their SQL: the same columns and, in any order, the same rows."""

import os

import duckdb


def views(root):
    connection = duckdb.connect()
    for file in os.listdir(root):
        path = f"{root}/{file}"
        path += "/*.parquet" if os.path.isdir(path) else ""
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return connection


def cell(x):
    if x is None or x != x:
        return "null"
    return f"{x:.6g}" if isinstance(x, float) else str(x)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(cell, r)) for r in frame.astype(object).itertuples(index=False))


def assert_same(df, sql, connection):
    got, want = df.toPandas(), connection.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
