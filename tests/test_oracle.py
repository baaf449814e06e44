"""Every registered query against its DuckDB oracle (sf0.001 by default;
TILLBOOK_ORACLE_SF=/root/testdata/sf0.01 reproduces the driver's gate)."""

import os

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck
from tillbook.registry import QUERIES

SF = os.environ.get("TILLBOOK_ORACLE_SF", "/root/testdata/sf0.001")
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_ledger_query_has_sql():
    assert set(QUERIES) <= set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, E.queries()[name], ORACLE[name], SF)
    assert res["cols_match"] and res["values_match"], res


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["expense", "income"] and len(rows) == 1
