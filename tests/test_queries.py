"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import importlib
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

DATA = "/root/testdata/sf0.001"
CORE = {k: (f, m.ORACLE.get(k)) for m in map(importlib.import_module, entry.CORE) for k, f in m.QUERIES.items()}
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", [k for k, (_, sql) in CORE.items() if sql])
def test_same_rows_as_sql(spark, con, name):
    assert differences(CORE[name][0](spark, DATA), con, CORE[name][1]) == ""


@pytest.mark.parametrize("name", [k for k, (_, sql) in CORE.items() if not sql])
def test_runs(spark, name):
    assert CORE[name][0](spark, DATA).count() >= 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ref_table", "period", "from_id", "to_key"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
