"""Every registered query against its SQL."""

import pytest
from conftest import SF_DIR

import __spark_entry__ as contract
from compare import compare

from chunkloom.plans import catalog

QUERIES, ORACLE = catalog.QUERIES, catalog.ORACLE


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    problems, _, rows = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_DIR)
    assert not problems, "\n".join(problems)
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
