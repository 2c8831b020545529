"""Whole runs of the engine against their SQL counterparts, and what is left when parts are taken out."""

import os
import shutil
import subprocess
import sys

import duckdb
import pandas as pd
import pytest

from lociflow import driver_runs
from tests.test_driver_views import DATA, TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(driver_runs.queries()))
def test_equals_sql(spark, db, name):
    got = driver_runs.queries()[name](spark, DATA).toPandas()
    want = db.execute(driver_runs.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    sort = lambda d: d[columns].astype(object).where(d[columns].notna(), None).sort_values(columns, key=lambda c: c.astype(str)).reset_index(drop=True)
    pd.testing.assert_frame_equal(sort(got), sort(want), check_dtype=False)


@pytest.mark.parametrize("gone", [["lociflow/llm", "tests/llm"], ["lociflow/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_registry_without_the_corpus_operators(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True)
        path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flag_summary' in q and 'run_records' in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
