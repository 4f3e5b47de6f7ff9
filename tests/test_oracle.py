"""Every registered query against its SQL, on the smallest tables."""

import pytest

import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_registry():
    names = oracle.contract.queries()
    assert oracle.contract.oracle_sql().keys() <= names.keys()


@pytest.mark.parametrize("name", list(oracle.contract.queries()))
def test_query(spark, con, name):
    message, _ = oracle.compare(spark, con, SF, name)
    assert not message


def test_entry(spark):
    assert oracle.contract.entry(spark).count() > 0
