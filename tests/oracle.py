"""Compare a query with its SQL twin in DuckDB: columns, rows and values, whatever the order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or (not isinstance(v, (list, tuple, str)) and not hasattr(v, "tolist") and pd.isna(v)):
            return "\0"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
            return repr(float(v))
        return str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def assert_same(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> None:
    assert sorted(spark_df.columns) == sorted(sql_df.columns)
    a, b = rows(spark_df), rows(sql_df)
    assert len(a) == len(b)
    assert a == b, [(x, y) for x, y in zip(a, b, strict=True) if x != y][:3]
