"""Every registered query against its DuckDB query on the driver tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from compare import compare, duck

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, con, sf_dir, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert len(rows) == 21 and all(r["overlap_items"] == 0 for r in rows)
