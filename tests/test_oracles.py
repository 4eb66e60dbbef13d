"""Every registered query with an SQL oracle, compared with DuckDB over the smallest supplied tables."""

import duckdb
import pandas as pd
import pytest

from fabula.plans import catalog

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df = df.assign(**{c: df[c].round(5)})
    return df.sort_values(list(df.columns)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_agrees_with_its_oracle(spark, con, name):
    got, want = catalog.queries()[name](spark, SF_DIR).toPandas(), con.execute(catalog.oracles()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    pd.testing.assert_frame_equal(tidy(got), tidy(want))
