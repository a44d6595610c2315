"""Compare a query with its SQL twin, rows in any order."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _cell(x):
    if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return None
    try:  # a column with nulls may come as floats from one side and as integers from the other
        return str(x) if isinstance(x, str) else round(float(x), 6)
    except (TypeError, ValueError):
        return str(x)


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(_cell(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


def same(spark, con, fn, sql: str, sf: str) -> None:
    got, want = fn(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
