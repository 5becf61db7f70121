"""Every registered query against its DuckDB equivalent on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tessera.plans import catalogue
from tests import oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, duck, name):
    columns, found = oracle.rows(catalogue.QUERIES[name](spark, SF_DIR).toPandas())
    expected_columns, expected = oracle.rows(duck.execute(catalogue.ORACLES[name]).df())
    assert columns == expected_columns
    assert found == expected


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF_DIR).columns


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalogue.QUERIES) <= set(entry.queries())
