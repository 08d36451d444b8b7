"""Counts and rankings over the log table and its rollups, for all entities at
once; a caller filters the result and the filter reaches the scan."""

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import row_count
from ..functions.times import ago, moment, since
from .sequence import top_per


def first_of(df: DataFrame, limit: int | None, *order) -> DataFrame:
    """A ranking's first rows where the caller asks for a number of them; else all rows."""
    return df if limit is None else df.orderBy(*order).limit(limit)


def breadth(rows, key: str, dimensions: dict, least=None) -> DataFrame:
    """Exact numbers of different values per key.  ``dimensions``: name to column; nulls
    do not count.  Equal combinations are counted once before they are unrolled, and every
    value once, so no row is copied for each dimension as several distinct counts would."""
    combos = rows.select(key, *[col.alias(name) for name, col in dimensions.items()]).distinct()
    pairs = F.array(*[F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value")) for name in dimensions])
    values = (combos.select(key, F.explode(pairs).alias("p")).select(key, "p.dimension", "p.value")
              .where("value is not null").distinct())
    return values.groupBy(key).agg(*[F.count_if(F.col("dimension") == name).alias(name) for name in dimensions])


def event_counts(logs):
    return logs.groupBy("src_ip").agg(row_count("events"))


def first_last_seen(logs):
    return logs.groupBy("src_ip").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def threat_counts(logs, limit=None):
    counted = logs.groupBy("src_ip", "threat_type").agg(row_count("events"))
    return top_per(counted, ["src_ip"], [F.desc("events"), "threat_type"], limit)


def severity_counts(logs):
    return logs.groupBy("src_ip", "severity").agg(row_count("events"))


def trail_summary(logs):
    """Total, first, last, per-severity counts and whether anything was hot."""
    sev = lambda s: F.count_if(F.col("severity") == s)
    return (logs.groupBy("src_ip").agg(
        row_count("total"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        sev("critical").alias("critical"), sev("high").alias("high"),
        sev("medium").alias("medium"), sev("low").alias("low"))
        .withColumn("is_hot", (F.col("critical") > 0) | (F.col("high") > 0)))


def top_ips(rollup, size=None):
    return first_of(rollup.groupBy("src_ip").agg(F.sum("events").alias("events")), size, F.desc("events"), "src_ip")


def ip_count(rollup):
    return rollup.agg(F.countDistinct("src_ip").alias("unique_ips"))


def hot_ips(rollup, size=None):
    return top_ips(rollup.where(F.col("severity").isin("critical", "high")), size)


def global_threats(rollup, include_unknown=False, limit=None):
    if not include_unknown:
        rollup = rollup.where(~F.col("threat_type").isin("unknown", ""))
    return first_of(rollup.groupBy("threat_type").agg(F.sum("events").alias("events")), limit,
                    F.desc("events"), "threat_type")


def global_severities(rollup):
    return rollup.groupBy("severity").agg(F.sum("events").alias("events"))


def technique_counts(logs, days=90, as_of=None, stored=None):
    """Events per technique id; a field may list several.  With the stored rollup of
    fields per day, only the day in which the window begins is read row by row."""
    bound = ago(moment(as_of, logs), days=days)
    rows = since(logs, bound)
    if stored is not None:
        rows = rows.where((F.col("day") == F.to_date(bound)) if "day" in logs.columns else F.to_date("ts") == F.to_date(bound))
    fields = rows.where("mitre != ''").groupBy("mitre").agg(row_count("events"))
    if stored is not None:
        fields = fields.unionByName(stored.where(F.col("day") > F.to_date(bound)).select("mitre", "events"))
    return (fields.select(F.explode(F.split(F.upper("mitre"), r"[,\s]+")).alias("technique"), "events")
            .where("technique != ''").groupBy("technique").agg(F.sum("events").alias("events")))


def ips_with_prefix(rollup, prefix, limit=None):
    return top_ips(rollup.where(F.col("src_ip").startswith(prefix)), limit)


def top_values(logs, column, limit=None):
    return first_of(logs.where(F.col(column) != "").groupBy(column).agg(row_count("events")), limit, F.desc("events"), column)


def user_countries(logs):
    return logs.where("username != '' and country != ''").select("username", "country").distinct()


def entity_aggregates(logs, column="username", limit=None):
    """Volume and breadth per entity (blank values count as a value)."""
    rows = logs.where(F.col(column) != "").withColumn("entity", F.col(column))
    wide = breadth(rows, "entity", {"dsts": F.col("dst_ip"), "ports": F.col("dst_port"), "countries": F.col("country"),
                                    "srcs": F.col("src_ip")})
    totals = rows.groupBy("entity").agg(row_count("events"), F.count_if(F.col("severity") == "critical").alias("crit"))
    return first_of(totals.join(wide, "entity", "left").fillna(0, ["dsts", "ports", "countries", "srcs"]), limit,
                    F.desc("events"), "entity")


SUMMARY_DIMENSIONS = ["threat_type", "severity", "src_ip", "username"]


def entity_summary(logs, column="src_ip", limit=50):
    """Totals of every entity, and its busiest values per dimension, as one long
    frame (entity, dimension, value, events, first_seen, last_seen).

    Rows are counted by the full combination before the dimensions are unrolled."""
    entity = F.col(column).alias("entity")
    cells = (logs.where(F.col(column) != "").groupBy(entity, *SUMMARY_DIMENSIONS)
             .agg(row_count("events"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")))
    pairs = [F.struct(F.lit("total").alias("dimension"), F.lit("").alias("value"))]
    pairs += [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in SUMMARY_DIMENSIONS]
    long = (cells.select("entity", F.explode(F.array(*pairs)).alias("p"), "events", "first_seen", "last_seen")
            .select("entity", "p.dimension", "p.value", "events", "first_seen", "last_seen")
            .where("not (dimension in ('src_ip', 'username') and value = '')")
            .groupBy("entity", "dimension", "value")
            .agg(F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"),
                 F.max("last_seen").alias("last_seen")))
    return top_per(long, ["entity", "dimension"], [F.desc("events"), "value"], limit)


def hourly_trend(rollup, hours=24, as_of=None):
    bound = ago(moment(as_of, rollup, "hour"), hours=hours)
    hot = F.when(F.col("severity").isin("high", "critical"), F.col("events")).otherwise(0)
    return (since(rollup, bound, "hour").groupBy("hour")
            .agg(F.sum("events").alias("total"), F.sum(hot).alias("hot")))


def threat_recurrence(logs, window_days=30, as_of=None):
    """How often and how badly each threat type recurs."""
    recent = since(logs, ago(moment(as_of, logs), days=window_days)).where("threat_type != ''")
    return recent.groupBy("threat_type").agg(
        row_count("events"), F.countDistinct("src_ip").alias("ips"), F.max("rule_level").alias("max_lvl"),
        F.count_if(F.col("severity").isin("high", "critical")).alias("hi"),
        F.count_if(F.col("severity") == "critical").alias("crit"),
        (F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) + 1).alias("span_days"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def blast_radius(members, logs, as_of=None):
    """What an action on the addresses of an incident would touch.
    ``members``: (incident_id, ip)."""
    recent = ago(moment(as_of, logs), hours=24)
    touched = logs.join(members.distinct(), logs["src_ip"] == F.col("ip"))
    return touched.groupBy("incident_id").agg(
        F.countDistinct("agent").alias("hosts"),
        F.countDistinct(F.nullif("username", F.lit(""))).alias("users"),
        F.countDistinct("dst_ip").alias("dst_ips"), row_count("events"),
        F.count_if(F.col("ts") >= recent).alias("events_24h"))


def alert_counts(newest):
    """Alerts and critical alerts per address, over the newest state."""
    return newest.groupBy("ip").agg(row_count("baseline_alerts"),
                                    F.count_if(F.col("severity") == "critical").alias("critical_alerts"))


def alert_type_counts(newest):
    return newest.groupBy("type").agg(row_count("alerts"))


def alert_totals(newest):
    return newest.agg(row_count("alerts"),
                      F.countDistinct(F.when(F.col("severity") == "critical", F.col("ip"))).alias("critical_ips"))


def deviation_summaries(newest, window=None, sample=10):
    """Weighted score, count and kinds of an address's alerts (or of its ``window`` newest);
    ``alerts`` shows the ``sample`` newest."""
    points = (F.when(F.col("severity") == "critical", 10).when(F.col("severity") == "high", 5)
              .when(F.col("severity") == "medium", 2).otherwise(1))
    recent = top_per(newest, ["ip"], [F.desc("ts"), "type"], window, rank="rank")
    alert = F.when(F.col("rank") <= sample, F.struct("rank", "type", "severity", "ts"))
    return recent.groupBy("ip").agg(
        row_count("alert_count"), F.sum(points).alias("deviation_score"),
        F.array_sort(F.collect_set("type")).alias("alert_types"),
        F.array_sort(F.collect_list(alert)).alias("alerts"))


def subnet_clusters(rollup, newest):
    """/24 networks with more than one address."""
    from ..functions.columns import band, subnet24
    events = rollup.groupBy("src_ip").agg(F.sum("events").alias("events"))
    alerts = newest.groupBy(F.col("ip").alias("src_ip")).agg(row_count("alerts"))
    joined = (events.join(alerts, "src_ip", "left").withColumn("subnet24", subnet24(F.col("src_ip")))
              .where("subnet24 != ''"))
    level = F.when(F.col("total_events") > 500, "critical").when(F.col("total_events") > 100, "high") \
        .otherwise("medium")
    return (joined.groupBy("subnet24").agg(
        row_count("ip_count"), F.sum("events").alias("total_events"),
        F.sum(F.coalesce("alerts", F.lit(0))).alias("total_alerts"))
        .where("ip_count > 1").withColumn("threat_level", level))


def active_ips(logs, as_of=None):
    """Addresses seen in the last day."""
    bound = ago(moment(as_of, logs), hours=24)
    return since(logs, bound).where(F.col("ts") > bound).where("src_ip != ''").select("src_ip").distinct()


def neighbours(rollup, size=50, keep=6):
    """Busiest other addresses in the same /24.  Only the ``keep + 1`` busiest of a
    network can be anyone's neighbour, so no pairs of whole networks are formed."""
    from ..functions.columns import subnet24
    ips = (rollup.groupBy("src_ip").agg(F.sum("events").alias("events"))
           .withColumn("subnet24", subnet24(F.col("src_ip"))).where("subnet24 != ''"))
    best = top_per(ips, ["subnet24"], [F.desc("events"), "src_ip"], keep + 1).select(
        "subnet24", F.col("src_ip").alias("related_ip"), F.col("events").alias("related_events"))
    pairs = ips.join(best, "subnet24").where("src_ip <> related_ip")
    return top_per(pairs, ["src_ip"], [F.desc("related_events"), "related_ip"], keep, rank="rank") \
        .select("src_ip", "related_ip", "related_events", "rank")
