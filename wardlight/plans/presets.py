"""Ready questions and dashboard panels.  Windows end at the newest row unless a
moment is given."""

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import row_count
from ..functions.times import ago, moment, since
from ..operators.counts import first_of


def _newest(df, columns, limit=200):
    tie = ["event_id"] if "event_id" in df.columns else []
    return df.orderBy(F.desc("ts"), *tie, "src_ip").limit(limit).select(*columns)


def outside_brute_force(logs, home="India", hours=6, as_of=None) -> DataFrame:
    """Brute force from abroad, private sources left out."""
    rows = since(logs, ago(moment(as_of, logs), hours=hours)).where(
        F.lower("threat_type").contains("brute") & ~F.col("country").isin(home, "")
        & ~F.col("src_ip").startswith("10.") & ~F.col("src_ip").startswith("192.168."))
    return _newest(rows, ["ts", "src_ip", "country", "threat_type", "severity", "rule"])


def busiest_ips(logs, hours=24, limit=20, as_of=None, exact=True) -> DataFrame:
    kinds = F.countDistinct if exact else F.approx_count_distinct
    return (since(logs, ago(moment(as_of, logs), hours=hours)).groupBy("src_ip")
            .agg(row_count("events"), F.count_if(F.col("severity") == "critical").alias("critical"),
                 kinds("threat_type").alias("threat_types"))
            .orderBy(F.desc("events"), "src_ip").limit(limit))


def lateral_events(logs, hours=24, as_of=None) -> DataFrame:
    rows = since(logs, ago(moment(as_of, logs), hours=hours)).where(
        F.col("threat_type").isin("rdp_relay", "privilege_escalation"))
    return _newest(rows, ["ts", "src_ip", "dst_ip", "threat_type", "severity", "rule"])


def targeted_accounts(logs, days=7, limit=20, as_of=None, exact=True) -> DataFrame:
    ips = F.countDistinct if exact else F.approx_count_distinct
    return (since(logs, ago(moment(as_of, logs), days=days)).where("username != ''")
            .groupBy(F.col("username").alias("account"))
            .agg(row_count("events"), ips("src_ip").alias("source_ips"),
                 F.count_if(F.col("severity").isin("critical", "high")).alias("high_severity"))
            .transform(lambda df: first_of(df, limit, F.desc("events"), "account")))


def risky_not_blocked(scores, blocks, least=50, limit=200) -> DataFrame:
    """Current scores at or above the limit whose address is not blocked."""
    return (scores.where(F.col("risk_score") >= least).join(blocks.select("ip"), "ip", "left_anti")
            .orderBy(F.desc("risk_score"), "ip").limit(limit).select("ip", "risk_score", "is_anomaly"))


def hot_last_hour(logs, hours=1, as_of=None) -> DataFrame:
    rows = since(logs, ago(moment(as_of, logs), hours=hours)).where(F.col("severity").isin("critical", "high"))
    return _newest(rows, ["ts", "src_ip", "country", "threat_type", "severity", "rule"])


# --- panels ---------------------------------------------------------------------

def panel_rows(logs, start, end, severities=(), threats=(), search="") -> DataFrame:
    """Rows of a dashboard's time range and filters."""
    rows = since(logs, moment(start)).where(F.col("ts") <= moment(end))
    if severities:
        rows = rows.where(F.col("severity").isin(list(severities)))
    if threats:
        rows = rows.where(F.col("threat_type").isin(list(threats)))
    if search:
        s = search.lower()
        rows = rows.where(F.lower("rule").contains(s) | F.lower("src_ip").contains(s)
                          | F.lower("threat_type").contains(s))
    return rows


def panel_count(rows):
    return rows.agg(row_count("c"))


def panel_critical(rows):
    return rows.where("severity = 'critical'").agg(row_count("c"))


def panel_unique_ips(rows):
    return rows.agg(F.countDistinct("src_ip").alias("c"))


def panel_freshness(logs, as_of):
    """Seconds since the newest row; -1 for an empty table."""
    gap = F.unix_seconds(F.date_trunc("second", moment(as_of))) - F.unix_seconds(F.date_trunc("second", F.max("ts")))
    return logs.agg(F.coalesce(gap, F.lit(-1)).alias("s"))


def panel_series(rows, interval="1 hour"):
    return (rows.groupBy(F.window("ts", interval).start.alias("time"), "severity").agg(row_count("events")))


def panel_table(rows, limit=1000):
    return _newest(rows, ["ts", "src_ip", "dst_ip", "dst_port", "threat_type", "severity", "rule_level",
                          "country", "agent", "rule"], limit)
