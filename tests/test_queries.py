"""Each query against its SQL, on whole tables."""

import pytest

from __spark_entry__ import entry
from riverlake.checks.oracles import ORACLES
from riverlake.checks.queries import all_queries
from tests.compare import connect, difference

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(all_queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query_matches_sql(spark, con, name):
    assert difference(all_queries()[name](spark, SF_DIR), con, ORACLES[name]) == ""


def test_entry(spark):
    assert entry(spark).count() > 0
