"""Behaviour vectors per address and per entity."""

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, minute_crossings, moment, seconds, since
from .counts import breadth, first_of
from .sequence import gap_statistics

c = F.col


def _count(cond, name):
    return F.count_if(cond).alias(name)


def _threat(*names):
    return c("threat_type").isin(*names)


def reputation_features(logs) -> DataFrame:
    """Severity mix, breadth (blank values count, blank users do not), worst level,
    times and the five leading threats of every address."""
    sev = lambda s, n: _count(c("severity") == s, n)
    base = logs.groupBy("src_ip").agg(
        row_count("total"), sev("critical", "crit"), sev("high", "high"), sev("medium", "med"),
        sev("low", "low"), F.max("rule_level").alias("max_level"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    names = {"uniq_ports": c("dst_port"), "uniq_dsts": c("dst_ip"), "uniq_countries": c("country"),
             "uniq_users": F.nullif("username", F.lit(""))}
    base = base.join(breadth(logs, "src_ip", names), "src_ip", "left").fillna(0, list(names))
    from .sequence import top_per
    threats = logs.where("threat_type != ''").groupBy("src_ip", "threat_type").agg(row_count("events"))
    best = top_per(threats, ["src_ip"], [F.desc("events"), "threat_type"], 5, rank="rank")
    listed = best.groupBy("src_ip").agg(
        F.array_sort(F.collect_list(F.struct("rank", "threat_type", "events"))).alias("top_threats"))
    return base.join(listed, "src_ip", "left")


def entity_features(logs, entities=None, limit=None) -> DataFrame:
    """Vector of every entity, of the chosen ones, or of the busiest ``limit``; the
    leading threat comes from a count per threat, ties by name."""
    rows = logs.where("src_ip != ''")
    if entities is not None:
        rows = rows.join(entities.select(c("entity").alias("src_ip")).distinct(), "src_ip", "left_semi")
    base = rows.groupBy(c("src_ip").alias("entity")).agg(
        row_count("events"), F.max("rule_level").alias("max_lvl"), F.avg("rule_level").alias("avg_lvl"),
        _count(c("severity") == "critical", "crit"), _count(c("severity") == "high", "high"),
        F.max("ts").alias("last_seen"))
    some = lambda col: F.nullif(c(col), F.lit(""))
    names = {"uniq_dst": c("dst_ip"), "uniq_ports": some("dst_port"), "uniq_users": some("username"), "uniq_countries": c("country")}
    base = base.join(breadth(rows.withColumn("entity", c("src_ip")), "entity", names), "entity", "left").fillna(0, list(names))
    top = (rows.groupBy(c("src_ip").alias("entity"), "threat_type").agg(row_count("n"))
           .groupBy("entity").agg(F.max_by("threat_type", F.struct("n", "threat_type")).alias("top_threat")))
    out = base.join(top, "entity")
    return out if entities is not None else first_of(out, limit, F.desc("events"), "entity")


def window_features(logs, alerts=None, days=7, least=3, limit=None, as_of=None) -> DataFrame:
    """Feature vector of the last days, from one aggregate.  The mean gap is the
    span over the count; minimum and deviation of the gaps stay 0 in this form."""
    now = moment(as_of, logs)
    recent = since(logs, ago(now, days=days))
    n = F.count(F.lit(1))
    some = lambda col: F.nullif(col, F.lit(""))
    span = F.unix_seconds(F.date_trunc("second", F.max("ts"))) - F.unix_seconds(F.date_trunc("second", F.min("ts")))
    minutes = minute_crossings(F.min("ts"), now)
    out = recent.groupBy(c("src_ip").alias("ip")).agg(
        n.cast("double").alias("n_events"),
        (n / F.greatest(F.lit(1.0), minutes.cast("double"))).alias("event_rate_pm"),
        (span / F.greatest(F.lit(1), n - 1)).alias("avg_interval_s"),
        F.lit(0.0).alias("min_interval_s"), F.lit(0.0).alias("std_interval_s"),
        (F.count_if(c("severity") == "critical") / n).alias("pct_critical"),
        (F.count_if(c("severity") == "high") / n).alias("pct_high"),
        _count(_threat(*X.FAILURE_TYPES), "brute_force_cnt"), _count(_threat("ssh_bruteforce"), "ssh_bf_cnt"),
        _count(_threat("rdp_relay"), "rdp_cnt"), _count(_threat("db_scan"), "db_scan_cnt"),
        _count(_threat("known_malicious"), "known_bad_cnt"),
        _count(_threat("privilege_escalation"), "priv_esc_cnt"),
        _count(_threat("vpn_bruteforce"), "vpn_bf_cnt")).where(c("n_events") >= least)
    names = {"unique_dst_ips": some("dst_ip"), "unique_dst_ports": some("dst_port"), "unique_countries": some("country")}
    out = out.join(breadth(recent.withColumn("ip", c("src_ip")), "ip", names), "ip", "left").fillna(0, list(names))
    if limit:
        out = out.orderBy(F.desc("n_events"), "ip").limit(limit)
    return with_alert_counts(out, alerts)


def event_features(logs, alerts=None) -> DataFrame:
    """Feature vector with real gap statistics over all events of an address."""
    n = F.count(F.lit(1))
    real = lambda col: F.countDistinct(F.when(~F.trim(col).isin("", "None", "nan"), F.trim(col)))
    span = F.max(seconds(c("ts"))) - F.min(seconds(c("ts"))) + 1
    base = logs.groupBy(c("src_ip").alias("ip")).agg(
        n.alias("n_events"), F.bround(n / span * 60, 3).alias("event_rate_pm"),
        real("dst_ip").alias("unique_dst_ips"), real("dst_port").alias("unique_dst_ports"),
        real("country").alias("unique_countries"),
        F.bround(F.count_if(c("severity") == "critical") / n, 3).alias("pct_critical"),
        F.bround(F.count_if(c("severity") == "high") / n, 3).alias("pct_high"),
        _count(_threat("brute_force"), "brute_force_cnt"), _count(_threat("ssh_bruteforce"), "ssh_bf_cnt"),
        _count(_threat("rdp_relay"), "rdp_cnt"), _count(_threat("db_scan"), "db_scan_cnt"),
        _count(_threat("known_malicious"), "known_bad_cnt"),
        _count(_threat("privilege_escalation"), "priv_esc_cnt"), _count(_threat("vpn_bruteforce"), "vpn_bf_cnt"))
    gaps = gap_statistics(logs, ["src_ip"], seconds(c("ts")))
    part = lambda name: F.bround(F.coalesce(name, F.lit(0.0)), 3)
    gaps = gaps.select(c("src_ip").alias("ip"), part("mean_gap").alias("avg_interval_s"),
                       part("min_gap").alias("min_interval_s"), part("std_gap").alias("std_interval_s"))
    return with_alert_counts(base.join(gaps, "ip"), alerts)


def with_alert_counts(features, alerts=None) -> DataFrame:
    """Adds deviation alert counts, 0 where there are none."""
    if alerts is None:
        return features.withColumns({"baseline_alerts": F.lit(0), "critical_alerts": F.lit(0)})
    return (features.join(alerts.select("ip", "baseline_alerts", "critical_alerts"), "ip", "left")
            .fillna(0, ["baseline_alerts", "critical_alerts"]))
