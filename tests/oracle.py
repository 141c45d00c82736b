"""A Spark query's rows held against DuckDB's for the same tables."""

import glob
import math
from decimal import Decimal
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def tables(sf):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"create view {Path(path).stem} as select * from '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.9g}") + 0.0
    if isinstance(v, dict):
        return tuple(sorted((str(k), plain(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differ(spark, query, sql, sf="sf0.001"):
    """None if both give the same, else what differs first."""
    df = query(spark, str(DATA / sf))
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = tables(sf).execute(sql)
    theirs = rows([d[0] for d in got.description], got.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} and {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows and {len(theirs[1])}; only one has {next(iter(set(mine[1]) ^ set(theirs[1])), None)}"
    return next((f"{a}\n{b}" for a, b in zip(mine[1], theirs[1], strict=True) if a != b), None)
