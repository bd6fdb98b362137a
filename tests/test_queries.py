"""The driver contract: every registered query runs and equals its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, duck


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, folder, name):
    status, rows, _, detail = compare(spark, con, name, folder)
    assert status == ("same" if name in oracle_sql() else "rows only"), detail
    assert rows > 0 or name in ("last_window",)
