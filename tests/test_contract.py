import os

import duckdb
import pytest

import __spark_entry__ as contract
from loomgraph.plans import contract as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(None if x is None or x != x else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for n in os.listdir(SF):
        con.execute(f"CREATE VIEW {n.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{n}'")
    return con


@pytest.mark.parametrize("name", list(core.QUERIES))
def test_query(spark, duck, name):
    got = core.QUERIES[name](spark, SF).toPandas()
    if name in core.ORACLE:
        want = duck.execute(core.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
