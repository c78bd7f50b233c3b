"""Spark's rows against DuckDB's over the same tables."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cells(df, columns):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "NULL"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(text(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))


def same(spark_df, con, sql):
    ours, theirs = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert _cells(ours, columns) == _cells(theirs, columns)
