"""Compare a query with its SQL on the generated tables."""

import math
import os

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    import pandas as pd

    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else v
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False, name=None)), key=str)


def check(spark, con, fn, sql):
    got, want = fn(spark, DATA).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
