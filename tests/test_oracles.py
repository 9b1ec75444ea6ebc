"""Every core query that SQL can express, against its SQL."""

import pytest
from oracle import same_rows

from chartloom.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, catalogue.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(SQL)))
def test_other_queries_run(spark, data, name):
    df = catalogue.queries()[name](spark, data)
    assert df.count() >= 0 and df.columns
