"""Every catalog query against its SQL counterpart."""

import os

import pytest

from sensorframe.catalog import all_queries

from .compare import connect, differences

PATH = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(PATH)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    query = QUERIES[name]
    df = query.run(spark, PATH)
    if query.sql is None:
        assert df.count() > 0
        return
    found = [d for d in differences(df, con, query.sql) if d != "no rows"]
    assert not found, found
