"""Every registered query of the engine equals its SQL in DuckDB on the smallest tables."""

import compare
import pytest

from tidewell.plans import registry

SF = f"{compare.DATA}/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    assert compare.difference(registry.queries()[name](spark, SF), con, SQL[name]) == ""


def test_flagship_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
