"""Overview and report data sets, as tables of rows."""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C
from ..functions.columns import row_count
from ..functions.times import ago, moment, since
from ..operators import counts as K, rollups as R
from ..operators.sequence import top_per

c = F.col


def global_statistics(rollup, newest) -> DataFrame:
    """One long frame (part, key, value) of all headline numbers.

    ``rollup`` is the daily rollup, ``newest`` the newest deviation state."""
    row = lambda df, part, key, value: df.select(
        F.lit(part).alias("part"), key.alias("key"), value.cast("long").alias("value"))
    none = F.lit("")
    critical = newest.where("severity = 'critical'").select("ip").distinct()
    parts = [
        row(rollup.agg(F.sum("events").alias("n")), "total_logs", none, c("n")),
        row(K.ip_count(rollup), "unique_ips", none, c("unique_ips")),
        row(newest.agg(row_count("n")), "total_alerts", none, c("n")),
        row(K.global_threats(rollup), "threat_counts", c("threat_type"), c("events")),
        row(K.global_severities(rollup), "severity_counts", c("severity"), c("events")),
        row(K.hot_ips(rollup), "hot_ips", c("src_ip"), c("events")),
        row(K.alert_type_counts(newest), "alert_types", c("type"), c("alerts")),
        row(critical, "critical_ips", c("ip"), F.lit(1)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overview(rollup, logs, newest, size=200):
    """Headline numbers and the hottest addresses with their details."""
    from ..operators.trails import hot_ip_summaries
    return {"statistics": global_statistics(rollup, newest), "hot_ips": hot_ip_summaries(rollup, logs, size)}


def storage_overview(rollup, baselines, newest) -> DataFrame:
    one = lambda df, col: df.select(col).scalar()
    return rollup.agg(F.sum("events").alias("total_logs"), F.countDistinct("src_ip").alias("unique_ips")).withColumns({
        "baselines": one(baselines.agg(F.countDistinct("ip").alias("n")), c("n")),
        "deviations": one(newest.agg(row_count("n")), c("n"))})


WINDOWS = {"weekly": 7, "monthly": 30}


def report_tables(logs, newest, blocks, incidents, timeframe="weekly", as_of=None) -> dict[str, DataFrame]:
    """Tables of a weekly or monthly report, all over the report's window."""
    days = WINDOWS[timeframe]
    now = moment(as_of, logs)
    rows = since(logs, ago(now, days=days))
    rollup = R.daily(rows)
    threats = K.global_threats(rollup, limit=6)
    hot = K.hot_ips(rollup, 10).select("src_ip")
    cells = rollup.join(hot, "src_ip").groupBy("src_ip", "threat_type").agg(F.sum("events").alias("events"))
    driver = cells.groupBy("src_ip").agg(
        F.sum("events").alias("events"), F.max_by("threat_type", F.struct("events", "threat_type")).alias("driver"))
    alerts = newest.groupBy(c("ip").alias("src_ip")).agg(row_count("alerts"))
    top_ips = (driver.join(alerts, "src_ip", "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
               .withColumn("driver", F.replace("driver", F.lit("_"), F.lit(" "))))
    severities = rollup.join(hot, "src_ip").groupBy("severity").agg(F.sum("events").alias("events"))
    posture = rollup.agg(F.sum("events").alias("total_logs")).withColumns({
        "period_days": F.lit(days),
        "auto_blocked": blocks.agg(F.count_if(c("kind") == "auto").alias("n")).scalar(),
        "manual_blocked": blocks.agg(F.count_if(c("kind") == "manual").alias("n")).scalar()})
    return {"top_threats": threats, "top_ips": top_ips, "severities": severities,
            "alert_types": K.alert_type_counts(newest), "posture": posture,
            "incidents": incidents.orderBy(F.desc("priority"), "incident_id").limit(8)}


def retrain_due(registry, row_total, feature_total, as_of, hours=24, new_rows=10_000, least=5) -> DataFrame:
    """Whether the model should be trained again.  ``registry`` holds past trainings
    (trained_at, rows); ``row_total`` and ``feature_total`` are one-row counts (n)."""
    last = registry.agg(F.max("trained_at").alias("trained_at"), F.max_by("rows", "trained_at").alias("rows"))
    age = (F.unix_micros(moment(as_of)) - F.unix_micros("trained_at")) / 3.6e9
    total = row_total.select("n").scalar()
    ready = feature_total.select("n").scalar()
    fresh = F.greatest(F.lit(0), total - F.coalesce("rows", F.lit(0)))
    return last.select(F.coalesce(age, F.lit(999.0)).alias("hours"), fresh.alias("new_rows"),
                       ((F.coalesce(age, F.lit(999.0)) >= hours) | (fresh >= new_rows)).alias("due"),
                       (ready >= least).alias("enough"))


def refresh_due(batches, last_run, as_of, rows=20_000, cooldown=900) -> DataFrame:
    """Whether enough rows arrived since the last refresh and the pause is over.
    ``batches``: (arrived_at, rows).  A refresh scans for deviations first, against
    the old baselines, then rebuilds them, then trains."""
    start = F.lit(str(last_run)).cast("timestamp")
    rested = F.unix_seconds(moment(as_of)) - F.unix_seconds(start) >= cooldown
    arrived = F.coalesce(F.sum(F.when(c("arrived_at") > start, c("rows"))), F.lit(0))
    return batches.agg(arrived.alias("new_rows")).withColumn("due", (c("new_rows") >= rows) & rested)
