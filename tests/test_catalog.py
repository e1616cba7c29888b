"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(contract.oracle_sql())  # the other queries have tests of their own

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert name in contract.queries()
    assert compare(contract.queries()[name](spark, FOLDER), con, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
