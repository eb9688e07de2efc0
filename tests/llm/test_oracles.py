"""Operators that SQL can express, against their SQL on whole tables."""

import pytest

from framewright.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, name):
    assert compare(spark, sf, queries.QUERIES[name], queries.ORACLE[name], connect(sf)) == []
