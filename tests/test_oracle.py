"""Every core query that has SQL, against DuckDB on the smallest tables."""

import pytest

from lexweave.plans import books, files, merges, records, reports, streams, study, texts

from .compare import assert_same, views
from .conftest import SF

_MODULES = (records, reports, texts, study, merges, books, files, streams)
_SQL = {n: s for m in _MODULES for n, s in m.oracle_sql().items()}
_QUERIES = {n: f for m in _MODULES for n, f in m.queries().items()}


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(_SQL))
def test_same_as_sql(spark, con, name):
    assert_same(_QUERIES[name](spark, SF), con, _SQL[name])


def test_every_sql_has_a_query():
    assert set(_SQL) <= set(_QUERIES)


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
