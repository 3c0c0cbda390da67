"""Compare a query's rows with those of its SQL in DuckDB."""
import glob
import math
import os
from collections import Counter
from decimal import Decimal

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(tables=None):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, frame in (tables or {}).items():
        c.execute(f"DROP VIEW IF EXISTS {name}")
        c.register(name, frame)
    return c


def plain(v):
    if isinstance(v, Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else int(v) if v.is_integer() and abs(v) < 2**53 else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql, con):
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    theirs = rows_of([c[0] for c in got.description], got.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1], (list((mine[1] - theirs[1]).items())[:3], list((theirs[1] - mine[1]).items())[:3])
