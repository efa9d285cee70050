"""Every query with SQL against DuckDB; every other runs and returns rows."""

import duckdb
import pandas as pd
import pytest

from tidemark.plans import oracle, queries

SF = "/root/testdata/sf0.01"
TABLES = ["orders", "lineitem", "events", "embeddings"]
ALL, SQL = queries.queries(), oracle.oracle_sql()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith(("datetime", "date")) or df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NaT else str(pd.Timestamp(x)) if hasattr(x, "year") else x)
        elif df[c].dtype.kind == "f":
            df[c] = df[c] + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    got = ALL[name](spark, SF).toPandas()
    if name not in SQL:
        assert got.shape[1] > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    assert len(want) > 0
    pd.testing.assert_frame_equal(normal(got), normal(want), check_dtype=False, rtol=1e-12, atol=1e-12)
