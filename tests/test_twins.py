"""Every query with a DuckDB twin gives the twin's rows."""

import pytest
from comparing import rows_of, rows_of_sql

from ephemera import plans

TWINS = plans.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(name, spark, duck, sf):
    df = plans.queries()[name](spark, sf)
    twin = duck.sql(TWINS[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows_of(df) == rows_of_sql(duck, TWINS[name])


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(TWINS)))
def test_query_without_a_twin_runs(name, spark, sf):
    assert plans.queries()[name](spark, sf).limit(5).count() > 0
