"""Every registered query against its SQL on the same tables."""

import oracle
import pytest

import __spark_entry__ as entry_module
from catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    difference = oracle.compare(QUERIES[name](spark, FOLDER), duck, ORACLES[name])
    assert difference is None, difference


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["o_orderkey", "rule", "result", "text", "quality"]
    assert df.count() == 3 * spark.read.parquet(f"{FOLDER}/orders.parquet").count()


def test_entry_module_has_every_query():
    assert QUERIES.keys() <= entry_module.queries().keys() and ORACLES.keys() <= entry_module.oracle_sql().keys()
