"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from loomgraph.plans import registry
from tests.compare import connect, differences

registry.load()


@pytest.fixture(scope="module")
def con(small_dir):
    return connect(small_dir)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, small_dir, con, name):
    assert differences(registry.QUERIES[name](spark, small_dir), con, registry.ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_runs(spark, small_dir, name):
    assert registry.QUERIES[name](spark, small_dir).count() > 0


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
