"""Compares a query with its SQL as run by DuckDB over the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    cell = lambda v: None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else round(float(v), 6) if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None)), key=str)


def same_as_sql(spark, query, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    ours, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)
