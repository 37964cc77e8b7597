"""Comparison of a registered query with its DuckDB SQL."""

import os

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


def compare(spark, query, sql, sf=SF):
    df = query(spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted((tuple(plain(r[k]) for k in at) for r in cur.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert ours == theirs
