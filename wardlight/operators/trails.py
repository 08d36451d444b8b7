"""Event listings: trails of an entity, log search, login events, hot addresses."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, fixed as X
from ..functions.times import ago, moment, since
from ..schema import trail_column
from .counts import first_of, hot_ips
from .sequence import top_per

SEARCHED = ["country", "src_ip", "dst_ip", "rule", "threat_type", "username", "agent"]


def _key(df: DataFrame) -> Column:
    """Tiebreak of equal times: the event id, or the stable key of the content."""
    if "event_id" in df.columns:
        return F.col("event_id")
    return C.event_key(F.col("ts"), *[F.col(f) for f in C.EVENT_KEY_FIELDS])


def trail(logs, field, value, limit=None, newest_first=True, days=0, as_of=None):
    """Events of one entity; with a limit, the first so many."""
    rows = logs.where(F.col(trail_column(field)) == value)
    if days:
        rows = since(rows, ago(moment(as_of, logs), days=days))
    order = [F.desc("ts"), F.desc(_key(rows))] if newest_first else ["ts", _key(rows)]
    return first_of(rows, limit, *order)


def newest_per(logs, column="src_ip", limit=None):
    """The newest events of every entity."""
    return top_per(logs, [column], [F.desc("ts"), F.desc(_key(logs))], limit)


def recent_logs(logs, minutes=0, start="", end="", severities=(), min_level=0, search="",
                limit=None, as_of=None):
    """Log search.  Without any time bound or search text the last week is read."""
    if not (minutes or start or end or search):
        minutes = 7 * 1440
    rows = logs
    if minutes:
        rows = since(rows, ago(moment(as_of, logs), mins=minutes))
    if start:
        rows = since(rows, F.try_to_timestamp(F.lit(start)))
    if end:
        last = F.try_to_timestamp(F.lit(end))
        rows = rows.where(F.col("ts") <= last)
        rows = rows.where(F.col("day") <= F.to_date(last)) if "day" in rows.columns else rows
    if severities:
        rows = rows.where(F.col("severity").isin(list(severities)))
    if min_level:
        rows = rows.where(F.col("rule_level") >= min_level)
    if search.strip():
        text = search.strip().lower()
        rows = rows.where(reduce(lambda a, b: a | b, [F.lower(s).contains(text) for s in SEARCHED]))
    return first_of(rows, limit, F.desc("ts"), _key(rows))


def login_events(logs, days=0, as_of=None):
    rows = logs.where(F.col("threat_type").isin(X.LOGIN_TYPES) & (F.col("username") != ""))
    return since(rows, ago(moment(as_of, logs), days=days)) if days else rows


def hot_ip_cells(rollup, size=30):
    """Threat and severity counts of the hottest addresses (at most ``size`` of
    them, so the joined side is small by construction)."""
    hot = hot_ips(rollup, size).withColumnRenamed("events", "total")
    return (rollup.join(hot, "src_ip").groupBy("src_ip", "total", "threat_type", "severity")
            .agg(F.sum("events").alias("events")))


def hot_ip_summaries(rollup, logs, size=30, names=8):
    """Hottest addresses with their maps, times, people, hosts and likely identity.

    ``total`` counts critical and high events only, ``total_all`` every event."""
    c = F.col
    cells = hot_ip_cells(rollup, size)
    as_map = lambda col: F.map_from_entries(F.sort_array(F.collect_list(F.struct(col, "events"))))
    threats = cells.groupBy("src_ip", "threat_type").agg(F.sum("events").alias("events")) \
        .groupBy("src_ip").agg(as_map("threat_type").alias("threat_types"))
    severities = cells.groupBy("src_ip", "total", "severity").agg(F.sum("events").alias("events")) \
        .groupBy("src_ip", "total").agg(as_map("severity").alias("severities"), F.sum("events").alias("total_all"))
    hot = hot_ips(rollup, size).select("src_ip")
    seen = logs.join(hot, "src_ip", "left_semi")
    times = seen.groupBy("src_ip").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    who = (seen.groupBy("src_ip", C.person(c("username"), c("target_user"), c("agent")).alias("user"),
                        F.nullif(F.trim("agent"), F.lit("")).alias("host"))
           .agg(F.count(F.lit(1)).alias("events")))

    def ranked(column, list_name, count_name):
        per = (who.where(c(column).isNotNull()).groupBy("src_ip", column).agg(F.sum("events").alias("events")))
        entry = F.struct((-c("events")).alias("minus"), c(column).alias("name"))
        # the full count comes from a plain aggregate, the list from the best rows only
        counts = per.groupBy("src_ip").agg(F.count(F.lit(1)).alias(count_name))
        best = top_per(per, ["src_ip"], [F.desc("events"), column], names).groupBy("src_ip").agg(
            F.transform(F.array_sort(F.collect_list(entry)),
                        lambda e: F.struct(e["name"].alias("name"), (-e["minus"]).alias("events"))).alias(list_name))
        return counts.join(best, "src_ip")

    out = severities.join(threats, "src_ip").join(times, "src_ip", "left")
    for column, lists, count in [("user", "users", "user_count"), ("host", "hosts", "host_count")]:
        out = out.join(ranked(column, lists, count), "src_ip", "left")
    label = F.coalesce(c("users")[0]["name"], c("hosts")[0]["name"], c("src_ip"))
    kind = (F.when(c("users").isNotNull(), "user")
            .when(c("hosts").isNotNull(), F.when(c("hosts")[0]["name"].rlike(X.SENSOR_PATTERN), "sensor").otherwise("host"))
            .otherwise("ip"))
    return (out.withColumns({"user_count": F.coalesce("user_count", F.lit(0)),
                             "host_count": F.coalesce("host_count", F.lit(0)),
                             "identity": label, "identity_kind": kind,
                             "has_user": c("users").isNotNull(), "is_hot": F.lit(True)}))
