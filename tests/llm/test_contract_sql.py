"""The contract queries that SQL can express, against DuckDB."""

from __future__ import annotations

import pytest

from cadenza.llm import queries
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    assert_same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], duck(SF))
