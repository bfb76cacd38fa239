"""Every query of the catalog against its SQL."""

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from ledgerline.plans.catalog import QUERIES
from ledgerline.plans.oracle import ORACLE


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())
    assert set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf_dir, con, name):
    assert differences(contract.queries()[name](spark, sf_dir), con, contract.oracle_sql()[name]) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0
