"""Alert lines, flat rows and reference files."""

import json

import pytest

from pyspark.sql import functions as F

from wardlight.sources import alerts, flat, lookup


def rows_of(spark, *objects, **options):
    lines = spark.createDataFrame([(x if isinstance(x, str) else json.dumps(x),) for x in objects], "value string")
    return alerts.to_log_rows(lines, **options).collect()


def test_alert_cases(spark):
    full = {"timestamp": "2024-01-01T05:30:00.000+0530", "rule": {
        "id": "5710", "level": "13", "description": "sshd: authentication failed", "groups": ["sshd", "auth"],
        "mitre": {"id": ["T1110", "T1078"], "tactic": []}}, "agent": {"name": "web-1", "ip": "10.0.0.9"},
        "data": {"srcip": "None", "dstport": 22, "win": {"eventdata": {"ipAddress": "203.0.113.9"}}},
        "full_log": "x" * 3000}
    (r,) = rows_of(spark, full, "", "{broken", "[1, 2]", {"rule": {"level": 3}})
    assert r["src_ip"] == "203.0.113.9" and r["dst_port"] == "22"
    assert r["rule_groups"] == "sshd, auth" and r["mitre"] == "T1110, T1078" and r["mitre_tactic"] == ""
    assert (r["severity"], r["rule_level"], r["threat_type"]) == ("critical", 13, "ssh_bruteforce")
    assert len(r["full_log"]) == 3000 and json.loads(r["raw"]) == full
    assert r["ts"].isoformat() == "2024-01-01T00:00:00"


def test_texts_lists_and_objects_in_any_place(spark):
    alert = {"rule": {"description": "[High] ssh brute force", "groups": "{x} sshd", "id": 5, "level": 7, "pci_dss": [1, None, "b", True]},
             "data": {"srcip": "9.9.9.9", "user": ["a", "b"], "action": {"deny": 1}, "dstport": ["22"], "url": "[::1]/x"},
             "syscheck": {"path": ["/etc/a", "/etc/b"], "event": "{odd"}, "GeoLocation": {"country_name": ["DE"], "location": {"lat": 1.5, "lon": "2"}},
             "full_log": "[warn] {\"a\": 1}", "location": '["kept"]', "agent": "no object"}
    (r,) = rows_of(spark, alert)
    assert (r["rule"], r["rule_groups"], r["threat_type"]) == ("[High] ssh brute force", "{x} sshd", "ssh_bruteforce")
    assert (r["username"], r["action"], r["dst_port"], r["url"]) == ("a, b", "", "22", "[::1]/x")
    assert (r["sc_path"], r["sc_event"], r["country"]) == ("/etc/a, /etc/b", "{odd", "DE")
    assert (r["geo_lat"], r["geo_lon"], r["rule_id"], r["pci_dss"]) == (1.5, 2.0, "5", "1, None, b, true")
    assert (r["full_log"], r["location"], r["agent"]) == ('[warn] {"a": 1}', '["kept"]', "")


def test_alert_level_filter(spark):
    made = [{"rule": {"level": n}, "data": {"srcip": f"1.1.1.{n}"}} for n in (1, 5, 9)]
    kept = {r["src_ip"] for r in rows_of(spark, *made, min_level=4, sample_below=7, one_in=1)}
    assert kept == {"1.1.1.5", "1.1.1.9"}


def test_flat_rows(spark):
    data = [("vpn login_success", "warning", "", "9.9.9.9"), ("sshd failed password", "3", "8.8.8.8", ""), ("x", "1", "nan", "")]
    rows = spark.createDataFrame(data, "`rule.description` string, `data.level` string, `data.srcip` string, `agent.ip` string")
    got = {r["src_ip"]: r for r in flat.to_log_rows(rows).collect()}
    assert set(got) == {"9.9.9.9", "8.8.8.8"}
    assert (got["9.9.9.9"]["threat_type"], got["9.9.9.9"]["severity"]) == ("login_success", "high")
    assert (got["8.8.8.8"]["threat_type"], got["8.8.8.8"]["severity"]) == ("ssh_bruteforce", "high")
    assert got["8.8.8.8"]["dst_ip"] == "" and got["8.8.8.8"]["geo_lat"] == 0.0


def test_topology(spark, tmp_path):
    (tmp_path / "t.csv").write_text("IP Address, Switch Name,Floor\n10.0.0.1,sw1,1\n10.0.0.1,sw2,\n,sw3,3\n")
    (r,) = lookup.read_topology(spark, str(tmp_path / "t.csv")).collect()
    assert r["ip"] == "10.0.0.1" and r["attrs"] == {"switch_name": "sw2"}
    with pytest.raises(ValueError):
        lookup.topology_rows(spark.range(1).withColumn("_place", F.lit(1)))


def test_indicators(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps([{"_note": "x", "indicator": "10.0.0.0/8", "confidence": 60}]))
    (r,) = lookup.read_indicators(spark, str(tmp_path / "i.json")).collect()
    assert r["indicator"] == "10.0.0.0/8" and r["confidence"] == 60


def test_storage_and_retention(spark, tmp_path, plogs):
    from wardlight.sources import store
    path = str(tmp_path / "logs")
    store.write_logs(plogs, path)
    table = store.read_logs(spark, path)
    size = store.storage_statistics(table).first()
    assert size["rows"] == plogs.count() and size["partitions"] == table.select("day").distinct().count()
    gone = store.drop_old_days(spark, path, 10, "2024-01-31 00:00:00")
    assert gone and max(gone) < "2024-01-21"
    assert store.read_logs(spark, path).agg(F.min("day").cast("string")).first()[0] >= "2024-01-21"


def test_day_pruning_reaches_the_scan(spark, tmp_path, plogs):
    from wardlight.operators.trails import recent_logs
    from wardlight.sources import store
    path = str(tmp_path / "pruned")
    store.write_logs(plogs, path)
    plan = recent_logs(store.read_logs(spark, path), minutes=60, as_of="2024-01-31 00:00:00")
    assert "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().executedPlan().toString()


def test_long_texts_stay_whole_or_are_cut_after_the_policy_id(spark):
    import json
    log = "x" * 3000 + " policyid=77"
    line = json.dumps({"data": {"srcip": "10.0.0.1"}, "rule": {"description": "r" * 900, "level": 5}, "full_log": log})
    lines = spark.createDataFrame([(line,)], "value string")
    whole, short = alerts.to_log_rows(lines).first(), alerts.to_log_rows(lines, cut=True).first()
    assert (len(whole["rule"]), whole["full_log"], whole["policy_id"]) == (900, log, "")
    assert (len(short["rule"]), len(short["full_log"]), short["policy_id"]) == (200, 2000, "77")
    rows = spark.createDataFrame([("10.0.0.1", log, "r" * 900)], "`data.srcip` string, full_log string, `rule.description` string")
    whole, short = flat.to_log_rows(rows).first(), flat.to_log_rows(rows, cut=True).first()
    assert (len(whole["rule"]), whole["full_log"]) == (900, log) and (len(short["rule"]), len(short["full_log"]), short["policy_id"]) == (200, 2000, "77")


def test_listings_have_no_limit_of_their_own(spark):
    from wardlight.operators.counts import top_values
    from wardlight.sources import state
    rows = spark.range(12_000).selectExpr("concat('10.0.', id) AS ip", "'t' AS type", "'low' AS severity", "timestamp_seconds(id) AS ts", "cast(id as int) AS risk_score",
                                          "false AS is_anomaly", "timestamp_seconds(id) AS scored_at", "concat('u', id) AS username", "'login' AS action")
    assert state.newest_alerts(rows.select("ip", "type", "severity", "ts")).count() == 12_000
    assert state.score_list(rows.select("ip", "risk_score", "is_anomaly", "scored_at")).count() == 12_000
    assert state.audit_list(rows.select("username", "action", "ts")).count() == top_values(rows, "username").count() == 12_000
    assert state.newest_alerts(rows.select("ip", "type", "severity", "ts"), 5).count() == 5
