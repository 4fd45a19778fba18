"""Every catalog query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

from catalog import all_entries
from tests.check_catalog import compare, duck
from tests.conftest import DATA

ENTRIES = all_entries()


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("query", ENTRIES, ids=[e.name for e in ENTRIES])
def test_query(spark, con, query):
    status, info = compare(query.run(spark, DATA), con, query.sql)
    assert status in ("ok", "rows only"), info


def test_contract(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
