"""Every registered query against its oracle SQL on the smallest tables, plus the driver contract."""

import importlib
import os
import subprocess
import sys

import pytest

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")
duckdb = pytest.importorskip("duckdb")

from check_oracle import compare, connect  # noqa: E402

from tallyward.catalog import registered  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(registered()))
def test_query_matches_oracle(spark, con, name):
    query, sql = registered()[name]
    df = query(spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    ok, note = compare(con, df, sql)
    assert ok, note


def test_driver_contract(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    core = {name for name in entry.queries() if name in registered()}
    assert core - set(entry.oracle_sql()) == {"train_score"}


def test_catalog_needs_no_session():
    """The driver reads the registered names before it makes a session."""
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 90 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
