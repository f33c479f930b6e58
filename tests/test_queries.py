"""Every named query runs; those with SQL give the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables aren't here")
SLOW = {"run_experiment", "select_candidate"}
NAMES = sorted(n for n in entry.queries() if n not in SLOW)


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    if name in entry.oracle_sql():
        r = sql.sql(entry.oracle_sql()[name])
        assert sorted(r.columns) == columns
        want = sorted(([dict(zip(r.columns, x))[c] for c in columns] for x in r.fetchall()), key=repr)
        assert [repr(x) for x in got] == [repr(x) for x in want]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
