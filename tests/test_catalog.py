"""Every query of the catalog against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from quern.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in catalog.ORACLES:
        got = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        want = sorted(repr([r[names.index(c)] for c in sorted(names)]) for r in got.fetchall())
        assert sorted(repr([r[c] for c in sorted(names)]) for r in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
