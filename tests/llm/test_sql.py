"""The queries of this subpackage that SQL can express, against it."""

import pytest
from oracle import differences

from tracery.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    assert differences(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf) == ""
