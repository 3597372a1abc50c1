import pytest

import weftline.llm.queries as llm

from ..compare import check

SQL = llm.oracle_sql()


@pytest.mark.parametrize("name", list(llm.queries()))
def test_query(spark, name):
    check(spark, name, llm.queries()[name], SQL.get(name))
