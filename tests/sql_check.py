"""Compares a query's rows with those of its SQL, run by another engine on the same files."""

import glob
import math
import os

import duckdb
import pandas as pd

DATA = os.environ.get("MATCHLOOM_TEST_DATA", "/root/testdata/sf0.001")


def engine():
    c = duckdb.connect()
    c.execute("set enable_progress_bar = false")
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return round(float(x), 6) + 0.0
    return str(x)


def _alike(x, y):
    """Equal, but for the last digit of a rounded number that lay on the edge."""
    if isinstance(x, float) and isinstance(y, float):
        return math.isclose(x, y, rel_tol=1e-9, abs_tol=1.5e-4 if x != round(x) else 0)
    return x == y


def canonical(df):
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(_cell(x) for x in r) for r in df.itertuples(index=False)), key=str)


def same(spark, query, sql, c):
    a, b = canonical(query(spark, DATA).toPandas()), canonical(c.execute(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    different = [(x, y) for x, y in zip(a[1], b[1]) if not all(map(_alike, x, y))]
    assert not different, different[:3]
