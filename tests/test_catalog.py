"""Every registered query against its SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from corvane.plans.catalog import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    query, sql = QUERIES[name]
    assert compare(spark, con, SF_DIR, query, sql) == ""
