"""Every query of the library against its SQL, on the smallest tables."""

import os

import pytest

from twinframe.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = [tuple(r[c] for c in cols) for r in df.collect()]
    sql = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(sql.columns) == cols
    at = [sql.columns.index(c) for c in cols]
    theirs = [tuple(r[i] for i in at) for r in sql.fetchall()]
    assert sorted(mine, key=repr) == sorted(theirs, key=repr)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() > 0
