"""Every registered query of the engine against its SQL counterpart."""

import pytest
from compare import database, difference
from conftest import SF

from quern.plans import registry


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    df, sql = registry.queries()[name](spark, SF), registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, sql) == ""


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
