"""Every registered query against its SQL, at the smallest scale."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as registered
import check_oracles
from workload import oracles, queries

DATA = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    return check_oracles.duckdb_views(DATA)


#: Compared in Python instead, over a small dictionary: SQL would have to compare all pairs of words.
WITHOUT_SQL = {"name_conformance_words"}


def test_every_query_of_the_analyses_has_sql():
    assert queries.queries().keys() - WITHOUT_SQL == oracles.oracle_sql().keys()
    assert queries.queries().keys() <= registered.queries().keys()


@pytest.mark.parametrize("name", sorted(queries.queries().keys() - WITHOUT_SQL))
def test_query_equals_sql(spark, connection, name):
    ours, theirs = check_oracles.compare(spark, connection, name, DATA)
    assert ours == theirs == []


def test_entry(spark):
    assert registered.entry(spark).count() == 3
