"""Runs a query on Spark and its SQL on DuckDB over the same tables."""

import datetime
import decimal
import math
import os

import duckdb

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "entities concepts candidates synonym_requests vocabulary_decisions graphs quads observations documents mix_targets region nation customer supplier part orders lineitem events embeddings".split()


def plain(v):
    if v is None or isinstance(v, (bool, int, str)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(cursor_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in cursor_rows), key=repr)


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def check(spark, name, query, sql):
    df = query(spark, FOLDER)
    found = rows(df.collect(), df.columns)
    assert len(set(df.columns)) == len(df.columns)
    if sql is None:
        return
    cur = connect().execute(sql)
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns), name
    assert found == rows(cur.fetchall(), columns), name
