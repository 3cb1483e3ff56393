"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

from palimpsest import catalog

DATA = "/root/testdata/sf0.001"
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, compare, name):
    compare(catalog.queries()[name](spark, DATA), SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert catalog.flagship(spark, DATA).count() == 20
