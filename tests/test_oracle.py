"""Every SQL-checked catalog query equals its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

ORACLE_KEYS = sorted(E.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", ORACLE_KEYS)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.startswith("OK"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    out = df.collect()
    assert df.columns == ["rank", "source_ip", "events", "avg_threat_score", "max_threat_score"]
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1))
