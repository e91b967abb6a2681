"""Registered queries of the subpackage: parity with SQL where there is one, and the pipeline's shape."""

import pytest
from conftest import DATA
from parity import compare, connect

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from gridleaf.llm.oracles import ORACLES
from gridleaf.llm.queries import QUERIES


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_each_operator_has_a_query():
    names = set(queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_parity(spark, con, name):
    assert compare(spark, con, DATA, QUERIES[name], ORACLES[name]) == ""


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "substring_dedup", "mix", "pack"]
