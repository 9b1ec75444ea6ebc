"""Every query of the subpackage runs; SQL where there is some."""

import pytest
from oracle import same_rows

from chartloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, name):
    same_rows(spark, data, queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_other_queries_run(spark, data, name):
    assert queries.queries()[name](spark, data).count() > 0
