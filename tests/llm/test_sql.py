"""The corpus queries that have SQL, against DuckDB."""

import duckdb
import pandas as pd
import pytest

from lociflow.llm import entries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(entries.oracle_sql()))
def test_equals_sql(spark, db, name):
    got = entries.queries()[name](spark, DATA).toPandas()
    want = db.execute(entries.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda d: d[columns].astype(object).where(d[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)


def test_scratch_tables_go(spark, tmp_path):
    from lociflow.llm import common

    mark = common.marker(spark)
    a, b = common.stored(spark.range(3), "a"), common.stored(spark.range(4), "b")
    common.drop_since(spark, mark, b)
    assert b.count() == 4 and common.marker(spark) == mark + 1
    with pytest.raises(Exception, match="(?i)not.*exist"):
        a.count()
    common.drop_stored(b)
    assert common.marker(spark) == mark
