from __future__ import annotations

import pytest

import __spark_entry__ as entry
from brindle.plans import registry
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLES[name], SF) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
