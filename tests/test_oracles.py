"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf 0.01), plus the entry smoke check."""

import pytest

import __spark_entry__ as entry_mod
from cohortspark.plans.compare import compare, duckdb_connect
from cohortspark.plans.registry import ORACLES, QUERIES

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    return duckdb_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle(spark, con, key):
    pdf = QUERIES[key](spark, SF_SMALL).toPandas()
    odf = con.execute(ORACLES[key]).df()
    ok, msg = compare(pdf, odf)
    assert ok, msg


def test_entry_and_contract(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry_mod.queries())
    assert set(ORACLES) <= set(entry_mod.oracle_sql()) <= set(entry_mod.queries())
