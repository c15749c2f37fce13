"""Every registered query against its SQL text in DuckDB, on whole tables."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_oracles import compare, oracle_connection

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry(spark).count() == 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, folder, name):
    assert compare(QUERIES[name](spark, folder), con, ORACLES[name]).startswith("ok")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, folder, name):
    assert QUERIES[name](spark, folder).toArrow().num_rows > 0
