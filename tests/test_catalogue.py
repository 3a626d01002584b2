"""Every query of the engine against its SQL form."""

from __future__ import annotations

import pytest

from cadenza.plans import catalogue
from tests.oracle import assert_same, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql())


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, con, name):
    assert_same(catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name], con)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())
