"""Compare a query with its SQL twin as the driver does: rows, columns, and values without order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "null" if v is None else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in data)


def differs(df, con, sql):
    """None, or what is different."""
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = rows(names, res.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"{len(got)} rows for {len(want)}; {bad}"
    return None
