"""The numbered queries next to their SQL, on whole small tables."""

from __future__ import annotations

import pytest

from checks.compare import difference, oracle_connection
from chunkwell.llm.oracles import ORACLES
from chunkwell.llm.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(REGISTRY[name](spark, SMALL), con, ORACLES[name]) == ""
