"""Every query with a SQL twin agrees with it; every other one returns rows."""

import pytest
from compare import connect, differences

from tauframe.plans.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF_DIR).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_returns_rows(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)
