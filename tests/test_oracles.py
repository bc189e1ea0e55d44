"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sparkloom import registry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, db, name):
    got = registry.QUERIES[name](spark, D).toPandas()
    want = db.sql(registry.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    a, b = (x[cols].astype(str).sort_values(cols, ignore_index=True) for x in (got, want))
    assert len(a) == len(b)
    for c in cols:
        assert (a[c] == b[c]).all(), (c, a[a[c] != b[c]].head(3), b[a[c] != b[c]].head(3))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
