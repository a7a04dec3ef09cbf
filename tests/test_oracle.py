"""Every query that SQL can state, against DuckDB; the others must at least give rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, duck, name):
    assert differences(entry.queries()[name](spark, sf), duck, SQL[name]) == []


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize(
    "name", [n for n in sorted(entry.queries()) if n not in SQL]
)
def test_gives_rows(spark, sf, name):
    assert entry.queries()[name](spark, sf).limit(1).count() == 1
