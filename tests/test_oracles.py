"""Every registered query with SQL gives the SQL's rows on the small tables; the others give rows."""

import pytest

from momenta.queries import registry
from tests.compare import both
from tests.conftest import SMALL

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, name):
    got, expected = both(registry.queries()[name], SQL[name], spark, SMALL)
    assert got == expected


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert registry.queries()[name](spark, SMALL).count() > 0
