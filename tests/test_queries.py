"""Every query that has an oracle agrees with it; the others give rows."""

from __future__ import annotations

import pytest

from conftest import DATA, agree

import __spark_entry__ as entry

OWN = {k: f for k, f in entry._registered("QUERIES").items() if f.__module__.startswith("chargeaudit.") and ".llm." not in f.__module__}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, name):
    sql = entry.oracle_sql().get(name)
    if sql:
        agree(OWN[name](spark, DATA), sql)
    else:
        assert OWN[name](spark, DATA).count() > 0
