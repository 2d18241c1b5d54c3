"""A sample of registered queries against their SQL at the smallest useful scale (all: check.py)."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.01"
SAMPLE = ["synchronous_return_filter", "event_disposition", "driver_innovations", "sample_covariance", "greedy_forward", "gmv_weights", "signflip_maxt", "poet_two_series", "factor_form_gmv"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@needs_data
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    status, _, detail = check.compare(spark, con, name, SF)
    assert status.startswith("OK"), detail


@needs_data
def test_flagship_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_entry_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 0"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
