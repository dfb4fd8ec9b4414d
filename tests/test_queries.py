"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import pytest
from oracle import same

from sparkqa import queries as library

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_against_sql(spark, name):
    same(library.queries()[name](spark, SF), library.oracle_sql()[name], SF)


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_runs(spark, name):
    assert library.queries()[name](spark, SF).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
