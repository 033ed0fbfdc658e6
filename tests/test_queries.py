"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import compare, oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="session")
def connection():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, connection, name):
    problem = compare(spark, connection, name, QUERIES, ORACLES, FOLDER)
    assert problem in (None, "no rows on both sides")


def test_entry(spark):
    assert contract.entry(spark).count() > 0
