"""Compares a query with its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def written(value) -> str:
    if value is None or (pd.api.types.is_scalar(value) and pd.isna(value)):
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted(tuple(written(v) for v in r) for r in df[columns].itertuples(index=False))


def assert_same(query, sql: str, spark, sf_dir: str) -> None:
    have, want = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(have.columns) == sorted(want.columns)
    assert rows(have) == rows(want)
