"""Queries against DuckDB on the same tables.  WARDLIGHT_ALL=1 runs every query;
otherwise one or two of each area."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, duck

SOME = """derived_logs derived_planted_logs o108_flat_class o126_entity o133_alert_techniques o015_kept_logs
o208_indicator_matches o214_neighbours o306_reputation_features o324_entity_risk o310_hot_ip_summaries
o329_baseline_maps o331_subnet_clusters o334_global_statistics o401_latest_deviations o404_gap_statistics
o503_first_seen_ledger o601_deviations o603_account_takeovers o604_impossible_travel o605_user_risk
o607_silence_report o610_beacons o611_policy_report o617_stages o618_phases o627_incidents o630_playbook_matches
o633_resilience o704_fused_risk o712_label_queue o109_alert_rows o110_flat_rows o501_streamed_daily""".split()
KEYS = list(entry.queries()) if os.environ.get("WARDLIGHT_ALL") else SOME


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("key", KEYS)
def test_equals_sql(spark, con, folder, key):
    status, note, _ = compare(spark, con, folder, key, entry.queries(), entry.oracle_sql())
    assert status == "ok" or (status == "rows-only" and not note.startswith("0 ")), note


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
