"""Planted scenarios with known answers."""

from pyspark.sql import functions as F

from wardlight.operators import baseline as B, takeover as TO, telemetry as TE, users as U
from wardlight.operators import rollups as R
from wardlight.operators.trails import login_events
from wardlight.plans.sample_logs import AS_OF


def test_beacons(plogs):
    rows = {r["src_ip"]: r for r in TE.beacon_report(plogs, as_of=AS_OF).collect()}
    assert rows["10.9.9.9"]["period_s"] == 300.0 and rows["10.9.9.9"]["cv"] == 0.018
    assert not rows["10.9.9.9"]["likely_infra"] and rows["10.9.9.10"]["likely_infra"]
    assert "10.9.9.11" not in rows


def test_takeover(plogs):
    found = {r["username"]: r for r in TO.account_takeovers(login_events(plogs)).collect()}
    victim = found["ato.victim"]
    assert (victim["severity"], victim["failures"], victim["new_country"]) == ("critical", 25, True)
    assert victim["usual_countries"] == ["India"]
    assert "typo.user" not in found


def test_user_drivers(plogs):
    risk = {r["username"]: r for r in U.user_risk(plogs, as_of=AS_OF).collect()}
    assert "ato_pattern" in {d["kind"] for d in risk["ato.victim"]["drivers"]}


def test_silent_agent(plogs):
    status = {r["agent"]: r["status"] for r in TE.silence_report(plogs, as_of=AS_OF).collect()}
    assert status["host-silent"] == "silent_critical"


def test_novelty(plogs):
    ledger = R.first_seen(plogs)
    keys = {(r["kind"], r["key"]) for r in TE.novelties(ledger, 7, AS_OF).collect()}
    assert {("agent", "host-new"), ("user_host", "new.user|host-new"), ("binary", "/tools/rare")} <= keys
    assert "/tools/rare" in {r["proc_image"] for r in TE.rare_binaries(ledger).collect()}


def test_policies(plogs):
    rows = {r["policy"]: r for r in TE.policy_report(plogs, as_of=AS_OF).collect()}
    assert rows["PS"]["surge_x"] == 15.0 and rows["PS"]["new_countries_24h"] == ["Iran"]
    assert rows["PQ"]["went_quiet"]


def test_deviation_rules(plogs):
    base = B.build_baselines(plogs, AS_OF)
    found = B.deviation_scan(plogs, base, AS_OF)
    by_ip = {}
    for r in found.where(F.col("ip").isin("10.8.8.8", "192.0.2.10", "198.51.100.20", "192.0.2.11")).collect():
        by_ip.setdefault(r["ip"], set()).add(r["type"])
    assert {"port_shift", "sensitive_port_targeted", "new_subnet_reached", "new_rule_category",
            "rule_escalation", "dormant_ip_reactivated"} <= by_ip["10.8.8.8"]
    assert "automated_tool_detected" in by_ip["192.0.2.10"]
    assert "internal_host_reached" in by_ip["198.51.100.20"]
    assert {"first_success_after_failures", "new_rule_category"} <= by_ip["192.0.2.11"]


def test_an_address_with_many_destinations(spark):
    """200,000 known values of one address are rows, in plan and result."""
    start = F.lit("2024-01-01").cast("timestamp")
    i = F.col("id")
    old = spark.range(200_000).select(
        F.lit("10.0.0.9").alias("src_ip"), F.timestamp_add("SECOND", i.cast("int"), start).alias("ts"), F.lit("unknown").alias("threat_type"),
        F.concat_ws(".", F.lit("100"), F.floor(i / 65536), F.floor(i / 256) % 256, i % 256).alias("dst_ip"),
        (i % 60_000 + 1).cast("string").alias("dst_port"), F.lit("low").alias("severity"), F.lit("India").alias("country"), i.alias("event_id"))
    today = F.lit("2024-01-30 12:00:00").cast("timestamp")
    new = old.where("event_id < 3").withColumns({"ts": F.timestamp_add("MINUTE", F.col("event_id").cast("int"), today),
                                                 "event_id": F.col("event_id") + 10**6})
    new = new.withColumn("dst_port", F.when(F.col("event_id") == 10**6, "60001").otherwise(F.col("dst_port")))
    logs = old.unionByName(new)
    base = B.build_baselines(logs, AS_OF)
    row = base.addresses.first()
    assert (row["n_dst_ips"], row["n_ports"], row["event_count"]) == (200_000, 60_000, 200_000)
    found = {(r["event_id"], r["type"]) for r in B.deviations(logs, base, AS_OF).collect()}
    assert (10**6, "port_shift") in found and not any(e != 10**6 and kind == "port_shift" for e, kind in found)
    assert "map<" not in base.addresses.schema.simpleString() + base.values.schema.simpleString()


def test_stored_baselines_give_the_same(spark, plogs, tmp_path):
    base = B.build_baselines(plogs, AS_OF)
    B.write_baselines(base, str(tmp_path))
    kept = B.read_baselines(spark, str(tmp_path))
    rows = lambda b: sorted(map(tuple, B.deviations(plogs, b, AS_OF).collect()))
    assert rows(kept) == rows(base)
