"""Runs a query and its SQL side by side."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([cell(r[i]) for i in order] for r in found), key=repr)


def compare(spark, db, sf_dir, query, sql, some=True):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    out = db.execute(sql)
    its = rows([c[0] for c in out.description], out.fetchall())
    assert mine[0] == its[0]
    assert len(mine[1]) == len(its[1])
    assert mine[1] or not some
    for a, b in zip(mine[1], its[1], strict=True):
        assert a == b
