"""Rows of a Spark query against those of DuckDB."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(map(norm, value))
    return str(value) if type(value).__name__ == "Decimal" else value


def same(frame, con, sql):
    columns = sorted(frame.columns)
    ours = Counter(repr([norm(r[c]) for c in columns]) for r in frame.collect())
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = Counter(repr([norm(r[names.index(c)]) for c in columns]) for r in found.fetchall())
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
