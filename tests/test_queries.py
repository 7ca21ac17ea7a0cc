"""Every registered query of the library's own operators against DuckDB."""

import pytest
from .oracle import connect, rows_of, rows_of_sql

from prismata.plans import registry


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, sf, con, name):
    assert rows_of(registry.QUERIES[name](spark, sf)) == rows_of_sql(con, registry.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
