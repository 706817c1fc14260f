"""Every registered query against its SQL oracle (DuckDB) on the smoke data,
plus the driver contract."""

import pytest

import __spark_entry__ as entry
from shelfwise.plans import ORACLE, QUERIES, verify

from conftest import SMOKE_DIR


@pytest.fixture(scope="module")
def con():
    return verify.duck(SMOKE_DIR)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "clv_segment" in df.columns


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert len(QUERIES) == 102


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, con, key):
    r = verify.compare(spark, key, QUERIES[key], ORACLE[key], SMOKE_DIR, con)
    assert r["status"] in ("ok", "ok~"), r
