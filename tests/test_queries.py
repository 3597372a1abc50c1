import pytest

import weftline.queries as core

from .compare import check

SQL = core.oracle_sql()


@pytest.mark.parametrize("name", list(core.queries()))
def test_query(spark, name):
    check(spark, name, core.queries()[name], SQL.get(name))


def test_every_sql_has_a_query():
    assert set(SQL) <= set(core.queries())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
