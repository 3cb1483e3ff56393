"""Queries with SQL against it, on the smallest tables."""

import pytest

from palimpsest.llm.queries import llm_oracle_sql, llm_queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_same_rows_as_sql(spark, compare, name):
    compare(llm_queries()[name](spark, DATA), llm_oracle_sql()[name], DATA)
