"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import re
import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_points
from conftest import SMALL
from gaugeworks.queries import suite

ORACLES, QUERIES = suite.ORACLES, suite.QUERIES


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for column in frame.select_dtypes("datetime"):
        frame[column] = frame[column].astype("datetime64[us]")
    return frame.sort_values(list(frame.columns), na_position="last").reset_index(drop=True)


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in Path(SMALL).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    mine = normal(QUERIES[name](spark, SMALL).toPandas())
    theirs = normal(duck.execute(ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    pd.testing.assert_frame_equal(mine, theirs, check_dtype=False)


def test_every_query_has_an_oracle():
    assert set(suite.ORACLES) == set(suite.QUERIES)


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 5


def test_plans_have_no_cross_joins(spark):
    for name in ("jn_03_global_scalar", "cmp_04_recommend_scheduling", "agg_11_dashboard_summary"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("CartesianProduct|NestedLoopJoin", plan), name


def test_workers_do_not_need_the_package(tmp_path):
    """Executors only have Python: run a Python operator from a folder without this package."""
    root = Path(__file__).resolve().parents[1]
    script = tmp_path / "job.py"
    script.write_text(
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from pyspark.sql import SparkSession\n"
        "import __spark_entry__ as e\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"print('rows', e.queries()['ml_05_forest_score'](s, {SMALL!r}).count())\n"
    )
    done = subprocess.run(
        [sys.executable, str(script)], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "rows 500" in done.stdout, done.stderr[-2000:]
