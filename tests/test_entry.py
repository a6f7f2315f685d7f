import os

import pytest

import __spark_entry__ as driver
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data is not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_flagship(spark):
    rows = driver.entry(spark).collect()
    assert sum(r.n for r in rows) == 1000


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.queries()))
def test_query_equals_its_oracle(spark, con, name):
    rows, problem = compare(spark, con, SF_DIR, driver.queries()[name], driver.oracle_sql().get(name))
    assert problem is None and rows > 0
