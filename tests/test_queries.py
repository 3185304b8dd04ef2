"""Every registered query against its SQL twin on the smallest data."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, df.collect())
    assert got.total() > 0
    sql = entry.oracle_sql().get(name)
    if sql:
        rel = con.execute(sql)
        cols = [d[0] for d in rel.description]
        assert sorted(cols) == sorted(df.columns)
        assert got == rows_of(cols, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["department_id", "department", "cve_id_text", "severity", "assets", "to_review"]
    assert df.count() > 0
