"""Every registered query against its SQL, on the smallest tables (checks/compare.py has the rest)."""

import pytest

import __spark_entry__ as contract
from checks.compare import connect, differences
from checks.oracles import ORACLES
from checks.queries import QUERIES

@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, sf, name):
    assert differences(contract.queries()[name], contract.oracle_sql()[name], spark, con, sf) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() == 3
