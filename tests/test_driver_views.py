"""Every registered engine query against its SQL counterpart in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from lociflow import driver_views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(driver_views.queries()))
def test_equals_sql(spark, db, name):
    got = driver_views.queries()[name](spark, DATA).toPandas()
    want = db.execute(driver_views.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda d: d[columns].astype(object).where(d[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)
