"""A registered query against its SQL: exact integers and text, nine digits of floating-point numbers."""

import os
from collections import Counter

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def database(sf=SF):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def cell(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(cell(r[k]) for k in order) for r in found)


def same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cursor = database(sf).execute(sql)
    want = rows([d[0] for d in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert got[1] - want[1] == want[1] - got[1] == Counter()
    return sum(got[1].values())


def available():
    return os.path.isdir(SF)
