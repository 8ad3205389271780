"""Rows of a query and of its SQL, comparable."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, f, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = f(spark, sf_dir)
    cols = sorted(got.columns)
    want = con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(names) == cols

    def norm(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 8) + 0.0
        return v.isoformat() if isinstance(v, datetime.datetime) else v

    a = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    b = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and abs(p - float(q)) < 1e-7) for p, q in zip(x, y, strict=True)), (x, y)
