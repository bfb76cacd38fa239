"""Corpus queries against their SQL, over whole tables."""

import pytest
from compare import differences, duck

import __spark_entry__ as contract
from ledgerline.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), duck(sf_dir), ORACLE[name]) is None


def test_all_queries_are_registered():
    assert {*QUERIES, "pipeline"} <= set(contract.queries())
    assert {int(name[2:].split("_")[0]) for name in QUERIES} == set(range(1, 14))
