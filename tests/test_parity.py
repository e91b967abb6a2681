"""Every registered query against its SQL on the smallest scale."""

import pytest
from conftest import DATA
from parity import compare, connect

from __spark_entry__ import entry
from gridleaf.plans.oracles import ORACLES
from gridleaf.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_registry():
    assert set(ORACLES) == set(QUERIES)


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, DATA, QUERIES[name], ORACLES[name]) == ""
