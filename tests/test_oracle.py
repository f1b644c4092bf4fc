"""Every query of the library's own catalog against its DuckDB oracle on sf0.001 (the driver's gate runs sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import compare, duck
from wayfold.plans.catalog import catalog
from wayfold.plans.oracle import sql_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert set(sql_queries()) == set(catalog())
    assert set(catalog()) <= set(E.queries()) and set(sql_queries()) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", sorted(catalog()))
def test_query_matches_oracle(spark, con, key):
    out = compare(spark, SF, key, catalog()[key], sql_queries()[key], con)
    assert out["match"], out


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["event_id", "start_road", "dst", "cost", "within", "route"]
    assert df.count() > 0
