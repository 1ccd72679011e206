"""Compare a query with its SQL on DuckDB."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            c.sql(f"create view {t} as select * from read_parquet('{path}')")
    return c


def text(v) -> str:
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted(tuple(text(v) for v in r) for r in frame[cols].itertuples(index=False))


def same(spark, query, sql: str, sf_dir: str) -> None:
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
