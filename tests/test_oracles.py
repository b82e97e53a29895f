"""Every registered query against its SQL, on whole small tables."""

from __future__ import annotations

import os

import pytest

from checks.compare import difference, oracle_connection
from checks.oracles import ORACLES
from checks.queries import REGISTRY

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    assert difference(REGISTRY[name](spark, SMALL), con, ORACLES[name]) == ""


def test_queries_without_sql(spark):
    assert set(REGISTRY) - set(ORACLES) == {"search_ann", "build_index_buckets"}
    assert REGISTRY["build_index_buckets"](spark, SMALL).agg({"vectors": "sum"}).head()[0] == 2 * 500


def test_entry(spark):
    import __spark_entry__ as entry_points

    rows = entry_points.entry(spark).collect()
    assert len(rows) == 40
    assert entry_points.queries().keys() >= entry_points.oracle_sql().keys()
