"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from check_oracles import compare
from query_catalog import registry
from tests.conftest import SMALL

QUERIES = entry_points.queries()
ORACLES = entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    ok, note, _ = compare(spark, SMALL, name, QUERIES[name], ORACLES[name])
    assert ok, note


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(registry.QUERIES) == set(registry.ORACLES)
