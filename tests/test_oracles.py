"""Each query of the engine against its SQL in DuckDB."""

import pytest
from conftest import DATA, rows_of

from strataframe.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    wanted = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == wanted
