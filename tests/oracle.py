"""Compares a query with its SQL in DuckDB: columns by name, rows in any order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return db


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: repr(round(x, 6)) if isinstance(x, float) else repr(x)
    return sorted(tuple(value(r[i]) for i in order) for r in data)


def same(spark, query, sql, folder):
    df = query(spark, folder)
    found = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(found.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(found.fetchall(), found.columns)
