"""The registered llm queries against their SQL (DuckDB) on the smoke data."""

import pytest

import __spark_entry__ as entry
from shelfwise.llm.queries import ORACLE, QUERIES
from shelfwise.plans import verify

SMOKE_DIR = "/root/testdata/sf0.001"


def test_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_oracle(spark, key):
    r = verify.compare(spark, key, QUERIES[key], ORACLE[key], SMOKE_DIR, verify.duck(SMOKE_DIR))
    assert r["status"] in ("ok", "ok~"), r
