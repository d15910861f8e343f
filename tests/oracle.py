"""Compares a query with its SQL on DuckDB, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def have_data(folder=DATA):
    return os.path.isdir(folder)


def plain(value):
    if isinstance(value, float):
        return "NaN" if value != value else repr(value + 0.0)
    return value


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def check(df, sql, con=None):
    con = con or connect()
    got = multiset(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want = multiset([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
