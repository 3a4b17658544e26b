"""A quick cross-section of the registered queries against their SQL, and registry checks."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows

QUICK = [
    "a1_risk_fusion", "a5_domain_reputation", "j1_w1_w2_correlation", "j7_fp1_override_policy", "fu3_fu4_observe_urls", "fu6_lexical_url_score",
    "fe1_upi_ids", "fn4_collapse_space", "p20_dashboard_rows", "p22_channel_renderings", "j9_threshold_sweep", "o5_select_threshold", "u5_retention_purge",
    "u8_stratified_split", "w5_conversation_states", "s5_bot_updates", "t1_redelivery_dedup", "t6_incremental_reputation",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, sf, con, name):
    got, want = queries()[name](spark, sf).toPandas(), con.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) > 150


def test_entry(spark):
    out = entry(spark).collect()
    assert len(out) == 50 and out[0]["risk_score"] == 100
