"""Every query with SQL gives the same rows in Spark and DuckDB."""

import pytest

from evalloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(name, same):
    same(catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_registers_the_catalog():
    import __spark_entry__ as e

    assert set(catalog.queries()) <= set(e.queries())
