"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare, duckdb_con

from tallyframe.plans.registry import ORACLES, QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duckdb_con(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if n not in ORACLES]
    assert missing == [] or all(n.startswith("stream") for n in missing), missing


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sql = ORACLES.get(name)
    df = QUERIES[name](spark, SF_SMALL)
    if sql is None:
        assert df.count() >= 0
        return
    res = compare(df, con, sql)
    assert res["ok"], res["problems"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["ledger_id", "date", "net_worth"]
