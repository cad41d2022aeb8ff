"""Every registered query against its SQL twin on the smallest driver tables."""

import pytest

import __spark_entry__ as entry
from footfall.workload import catalog
from tests_support import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    err, _, df = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES.get(name), SF)
    assert err is None
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 2
