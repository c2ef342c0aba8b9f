"""Every registered query of the catalogue against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from shelfmark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "orders lineitem part events pages supplier".split():
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    text = lambda x: "" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, float | int) and not isinstance(x, bool) else str(x)
    return sorted(map(tuple, df.map(text).values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
