"""The registered queries of the subpackage against DuckDB where SQL can express them."""

import pytest

from prismata.llm import entries

from ..oracle import connect, rows_of, rows_of_sql


@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_same_as_sql(spark, sf, name):
    assert rows_of(entries.QUERIES[name](spark, sf)) == rows_of_sql(connect(sf), entries.ORACLE_SQL[name])


def test_all_are_registered():
    assert {n.split("_")[0] for n in entries.QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
