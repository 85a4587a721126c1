import pytest
from oracle import duck_rows, rows_of

from stillhouse.llm import queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_same_rows(spark, small, name):
    assert rows_of(queries.QUERIES[name](spark, small)) == duck_rows(queries.SQL[name], small)
