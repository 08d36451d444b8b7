"""Normal behaviour of every address, and events that deviate from it.

A baseline is two tables: one short row per address, and its known values in long form
(ip, dimension, value, events), however many there are.  Whether an event's value is
known is an equi-join on (ip, dimension, value).  Values of the scanned window are made
distinct and compared first; the few that are new to their address go into a 64-bit
Bloom filter per dimension on the address's row, which drops known values of events
before the exact join.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, moment, seconds, since, until
from .sequence import day_offsets, lent, parted, split_points, top_per

c = F.col
DIMENSIONS = ["ports", "dst_ips", "subnets", "countries", "hours", "weekdays", "threat_types", "days"]
#: Dimensions whose values are looked up one by one; hours and weekdays are masks, the rest is counted.
LOOKED_UP = ["ports", "subnets", "countries", "threat_types"]


class Baselines(NamedTuple):
    """``addresses``: a row per address; ``values``: (ip, dimension, value, events)."""

    addresses: DataFrame
    values: DataFrame

    def persist(self):
        return Baselines(self.addresses.persist(), self.values.persist())


def _known(name):
    text = F.trim(name)
    return F.when(~text.isin("", "None", "nan"), text)


def _values_of(names):
    """Struct (dimension, value) of each named dimension of a row."""
    dst = _known("dst_ip")
    found = {"ports": _known("dst_port"), "dst_ips": dst, "subnets": F.nullif(C.subnet24(dst), F.lit("")),
             "countries": _known("country"), "hours": F.hour("ts").cast("string"), "weekdays": F.weekday("ts").cast("string"),
             "threat_types": c("threat_type"), "days": F.date_format("ts", "yyyy-MM-dd"),
             "severities": F.coalesce("severity", F.lit(""))}
    return [F.struct(F.lit(n).alias("dimension"), found[n].alias("value")) for n in names]


def _counted(logs, names) -> DataFrame:
    return (logs.select(c("src_ip").alias("ip"), F.explode(F.array(*_values_of(names))).alias("p"))
            .select("ip", "p.dimension", "p.value").where("value is not null")
            .groupBy("ip", "dimension", "value").agg(row_count("events")))


def value_counts(logs) -> DataFrame:
    """Long form (ip, dimension, value, events) of the eight histograms; every task
    counts its rows before the shuffle."""
    return _counted(logs, DIMENSIONS)


def baseline_scalars(logs, least=10) -> DataFrame:
    n = F.count(F.lit(1))
    return (logs.groupBy(c("src_ip").alias("ip")).agg(
        n.alias("event_count"), F.countDistinct(F.to_date("ts")).alias("day_count"),
        F.bround(n / F.countDistinct(F.to_date("ts")), 2).alias("avg_daily_events"),
        F.bround(F.avg(C.severity_points(c("severity"))), 3).alias("avg_severity_score"),
        F.count_if(c("threat_type") == "login_success").alias("total_successes"),
        F.count_if(c("threat_type").isin(X.BASELINE_FAILURE_TYPES)).alias("total_failures"))
        .where(c("event_count") >= least).drop("day_count"))


def address_rows(values, least=10) -> DataFrame:
    """One row per address from its values: averages, how many values each dimension has,
    its hours and weekdays as bit masks and its last day."""
    types = ", ".join(f"'{t}'" for t in X.BASELINE_FAILURE_TYPES)
    days, graded = "sum(if(dimension = 'days', events, 0L))", "dimension = 'severities'"
    per = values.withColumn("points", C.severity_points(c("value")) * c("events")).groupBy("ip")
    return per.agg(*map(F.expr, [
        f"{days} AS event_count", f"bround({days} / count_if(dimension = 'days'), 2) AS avg_daily_events",
        f"bround(sum(if({graded}, points, 0L)) / sum(if({graded}, events, 0L)), 3) AS avg_severity_score",
        "sum(if(dimension = 'threat_types' AND value = 'login_success', events, 0L)) AS total_successes",
        f"sum(if(dimension = 'threat_types' AND value IN ({types}), events, 0L)) AS total_failures",
        *[f"count_if(dimension = '{d}') AS n_{d}" for d in DIMENSIONS],
        *[f"coalesce(bit_or(if(dimension = '{d}', shiftleft(1L, try_cast(value AS int)), NULL)), 0L) AS {d}_mask" for d in ("hours", "weekdays")],
        "date(max(if(dimension = 'days', value, NULL))) AS last_day"])).where(c("event_count") >= least)


def build_baselines(logs, as_of=None, until_hours=24, least=10) -> Baselines:
    """Baselines of addresses with at least ``least`` events.  Events of the last day are
    left out, so that they can be judged against what came before; ``until_hours=0``
    takes all.  ``values`` holds all addresses' values; those below ``least`` have no row."""
    rows = logs
    if until_hours:
        rows = until(logs, ago(moment(as_of, logs), hours=until_hours))
    counted = _counted(rows, [*DIMENSIONS, "severities"])
    return Baselines(address_rows(counted, least).withColumn("built_at", moment(as_of, logs)),
                     counted.where(c("dimension") != "severities"))


def write_baselines(base: Baselines, path: str) -> None:
    """Both tables, ordered by address, so that readers of some addresses skip the rest."""
    base.addresses.repartition("ip").sortWithinPartitions("ip").write.mode("overwrite").parquet(f"{path}/addresses")
    (base.values.repartition("ip", "value").sortWithinPartitions("ip", "dimension", "value")
     .write.mode("overwrite").partitionBy("dimension").parquet(f"{path}/values"))


def read_baselines(spark: SparkSession, path: str) -> Baselines:
    return Baselines(spark.read.parquet(f"{path}/addresses"), spark.read.parquet(f"{path}/values"))


# --- deviations ---------------------------------------------------------------------

CONTEXT = 49


def _tie(df):
    return ["event_id"] if "event_id" in df.columns else []


def _window(logs, as_of, hours):
    start = ago(moment(as_of, logs), hours=hours)
    return since(logs, start), until(logs, start), start


def judged(logs, addresses, as_of=None, hours=24) -> DataFrame:
    """Events of the last ``hours`` with their row of ``addresses`` and running context."""
    scan, older, start = _window(logs, as_of, hours)
    context = newest_rows(older.join(scan.select("src_ip").distinct(), "src_ip", "left_semi"), CONTEXT)
    # rows of the first day before the window count for the day's running number
    earlier = day_counts(older.where(F.to_date("ts") == F.to_date(start)))
    return in_context(scan, context, earlier, addresses)


def newest_rows(logs, keep) -> DataFrame:
    """The newest rows of each address."""
    return top_per(logs, ["src_ip"], [F.desc("ts"), *[F.desc(t) for t in _tie(logs)]], keep)


def day_counts(logs) -> DataFrame:
    return logs.groupBy("src_ip", F.to_date("ts").alias("day")).agg(row_count("events"))


def in_context(scan, context, earlier, addresses) -> DataFrame:
    """``scan`` rows with the distinct destinations of the last 50 events, the gaps of
    the last 20 and the position within the day, and their address's row.

    ``context`` holds the rows before them (the newest 49 per address suffice) and
    ``earlier`` the events per address of the day in which the scan begins that are in
    neither.  Busy addresses are cut into parts of counted rows, to which the rows of
    addresses are joined part by part, so none of this needs all rows of one in one task."""
    keys, order = ["src_ip"], ["ts", *_tie(scan)]
    need = [*dict.fromkeys(["src_ip", "ts", "dst_ip", "dst_port", "country", "threat_type", "severity", *_tie(scan)])]
    rows = scan.select(*need, F.lit(True).alias("_new"), F.to_date("ts").alias("_day"))
    points = split_points(rows, keys, order)
    cut = parted(rows, keys, order, points=points)
    # rows before the scan belong to the first part; they are too few to be lent on
    first = context.select(*need, F.lit(False).alias("_new"), F.to_date("ts").alias("_day"), F.lit(0).alias("_part"),
                           F.lit(False).alias("_hot"), F.lit(True).alias("_own"))
    both = lent(cut, keys, order, CONTEXT).unionByName(first)
    frame = W.partitionBy("src_ip", "_part").orderBy("_day", *order)
    gap = seconds(c("ts")) - F.lag(seconds(c("ts"))).over(frame)
    dst = F.collect_set(_known("dst_ip")).over(frame.rowsBetween(-CONTEXT, 0))
    last20 = frame.rowsBetween(-18, 0)
    in_day = W.partitionBy("src_ip", "_part", "_day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    timed = (both.withColumns({"_gap": gap, "recent_dsts": F.size(dst), "_hits": F.count_if(c("_new") & c("_own")).over(in_day)})
             .withColumns({"recent_gaps": F.count("_gap").over(last20), "avg_gap": F.avg("_gap").over(last20),
                           "std_gap": F.coalesce(F.stddev_samp("_gap").over(last20), F.lit(0.0))}).where(c("_own") & c("_new")))
    # an address's row once per part, with what its first day had before the scan
    known = (addresses.withColumnRenamed("ip", "src_ip")
             .join(earlier.select("src_ip", c("day").alias("_early_day"), c("events").alias("_early")), "src_ip", "left")
             .join(F.broadcast(points), "src_ip", "left")
             .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.size("_points"), F.lit(0))))).drop("_points"))
    offsets = day_offsets(cut, keys, c("_day"), c("_new"))
    before = (F.when(c("_early_day") == c("_day"), c("_early")).otherwise(0)
              + F.when(c("_first_day") == c("_day"), c("_day_before")).otherwise(0))
    return (timed.join(known, ["src_ip", "_part"]).join(F.broadcast(offsets), ["src_ip", "_part"], "left")
            .withColumn("today", c("_hits") + before)
            .drop("_gap", "_hits", "_part", "_hot", "_own", "_new", "_day", "_early_day", "_early", "_first_day", "_day_before"))


def unknown_values(events, base: Baselines) -> DataFrame:
    """Different (ip, dimension, value) of events that are new to an address with a baseline."""
    seen = (events.select(c("src_ip").alias("ip"), F.explode(F.array(*_values_of(LOOKED_UP))).alias("p"))
            .select("ip", "p.dimension", "p.value").where("value is not null").distinct())
    return (seen.join(base.addresses.select("ip"), "ip", "left_semi")
            .join(base.values.where(c("dimension").isin(*LOOKED_UP)), ["ip", "dimension", "value"], "left_anti"))


def events_with_known(events, base: Baselines, dimension: str) -> DataFrame:
    """Events of addresses with a baseline, and whether their value of a dimension is known."""
    value = _values_of([dimension])[0]["value"]
    known = base.values.where(c("dimension") == dimension).select("ip", "value", F.lit(True).alias("known"))
    asked = events.withColumn("value", value).where("value is not null").withColumn("ip", c("src_ip"))
    return (asked.join(base.addresses.select("ip"), "ip", "left_semi").join(known, ["ip", "value"], "left")
            .withColumn("known", F.coalesce("known", F.lit(False))).drop("ip"))


def deviations(logs, base: Baselines, as_of=None, hours=24) -> DataFrame:
    """One row per event and broken rule (ip, type, severity, ts, detail)."""
    unknown = unknown_values(_window(logs, as_of, hours)[0], base)
    return alerts_of(judged(logs, with_filters(base.addresses, unknown), as_of, hours), unknown)


def with_filters(addresses, unknown) -> DataFrame:
    """Adds a 64-bit Bloom filter of the address's unknown values per looked-up dimension."""
    bit = "shiftleft(1L, int(pmod(xxhash64(dimension, value), 64L)))"
    bits = unknown.groupBy("ip").agg(*[F.expr(f"bit_or(if(dimension = '{d}', {bit}, NULL)) AS _bits_{d}") for d in LOOKED_UP])
    return addresses.join(bits, "ip", "left")


#: Type, test, severity, detail, and where values are looked up, the dimension and value.
_RULES = [
    ("port_shift", "n_ports > 0 AND {ports}", "if(sensitive, 'critical', 'high')", "port", "ports", "port"),
    ("sensitive_port_targeted", "sensitive AND {ports}", "'critical'", "port", "ports", "port"),
    ("new_subnet_reached", "n_subnets > 0 AND {subnets}", "'high'", "subnet", "subnets", "subnet"),
    ("internal_host_reached", "dst IS NOT NULL AND dst_inside AND NOT src_inside", "'critical'", "dst"),
    ("target_shift", "n_dst_ips > 0 AND recent_dsts > n_dst_ips * 2 AND recent_dsts > 5", "'critical'", "string(recent_dsts)"),
    ("country_shift", "n_countries >= 2 AND {countries}", "'medium'", "place", "countries", "place"),
    ("off_hours_activity", "n_hours >= 5 AND hours_mask & shiftleft(1L, hour(ts)) = 0", "'high'", "string(hour(ts))"),
    ("weekend_anomaly", "n_weekdays > 0 AND weekday(ts) >= 5 AND weekdays_mask < 32", "'high'", "string(weekday(ts))"),
    ("volume_spike", "avg_daily_events > 5 AND today > avg_daily_events * 3", "'critical'", "string(today)"),
    ("new_rule_category", "n_threat_types > 0 AND {threat_types} AND threat_type <> 'unknown'", "if(escalates, 'critical', 'high')",
     "threat_type", "threat_types", "threat_type"),
    ("rule_escalation", "avg_severity_score > 0 AND points > avg_severity_score + 1.5", "'high'", "severity"),
    ("first_success_after_failures", "threat_type = 'login_success' AND total_failures >= 5 AND total_successes = 0", "'critical'",
     "string(total_failures)"),
    ("automated_tool_detected", "recent_gaps >= 9 AND avg_gap < 0.5 AND std_gap < 0.1", "'high'", "string(bround(avg_gap, 4))"),
    ("dormant_ip_reactivated", "datediff(date(ts), last_day) >= 7", "'high'", "string(datediff(date(ts), last_day))"),
]


def _rule(tests, name, test, severity, detail, dimension=None, value="string(NULL)"):
    kind = f"'{dimension}'" if dimension else "string(NULL)"
    return (f"CASE WHEN {test.format(**tests)} THEN named_struct('type', '{name}', 'severity', {severity}, 'detail', coalesce({detail}, ''), "
            f"'dimension', {kind}, 'value', {value}) END")


def shown_values(events) -> DataFrame:
    """Adds the values that rules look at: port, dst, place, subnet (null where not known)."""
    dst = _known("dst_ip")
    return events.withColumns({"port": _known("dst_port"), "dst": dst, "place": _known("country"),
                               "subnet": F.nullif(C.subnet24(dst), F.lit(""))})


def judged_values(shown) -> DataFrame:
    """Adds what rules ask of those values."""
    return shown.withColumns({
        "sensitive": F.coalesce(C.is_sensitive_port(c("port")), F.lit(False)), "dst_inside": C.is_internal(c("dst")),
        "src_inside": C.is_internal(c("src_ip")), "points": C.severity_points(c("severity")),
        "escalates": c("threat_type").isin(X.ESCALATION_TYPES)})


def raised(events, keep, tests) -> DataFrame:
    """The fourteen rules as one array per event, exploded.  ``tests``: by dimension, the
    SQL condition that an event's value of it is new to its address."""
    found = "filter(array(" + ", ".join(_rule(tests, *r) for r in _RULES) + "), a -> a IS NOT NULL)"
    return events.select(c("src_ip").alias("ip"), *keep, F.explode(F.expr(found)).alias("a")).select("ip", *keep, "a.*")


def alerts_of(events, unknown) -> DataFrame:
    """Deviations of events in context.  Rules about values that are new to an address
    first ask the filter of :func:`with_filters`, then ``unknown``."""
    bit = lambda d, v: f"shiftleft(1L, int(pmod(xxhash64('{d}', {v}), 64L)))"
    tests = {d: f"{v} IS NOT NULL AND _bits_{d} & {bit(d, v)} <> 0"
             for d, v in zip(LOOKED_UP, ["port", "subnet", "place", "threat_type"])}
    keep = ["ts", *_tie(events)]
    # alerts without a look-up get keys of their own, so they spread over the join's tasks
    keyed = raised(judged_values(shown_values(events)), keep, tests).selectExpr(
        "*", "coalesce(dimension, '') AS _d", f"coalesce(value, string(xxhash64({', '.join(keep)}))) AS _v")
    new = unknown.selectExpr("ip", "dimension AS _d", "value AS _v", "true AS _new")
    return keyed.join(new, ["ip", "_d", "_v"], "left").where("dimension is null or _new").select(
        "ip", *keep, "type", "severity", "detail")


def deviation_scan(logs, base: Baselines, as_of=None, hours=24) -> DataFrame:
    """Newest alert per (ip, type) of the scanned window."""
    found = deviations(logs, base, as_of, hours)
    return newest_alerts(found)


def newest_alerts(found) -> DataFrame:
    return found.groupBy("ip", "type").agg(F.max_by(
        F.struct("severity", "detail", "ts"), F.struct("ts", *_tie(found))).alias("a")).select("ip", "type", "a.*")


def rebuild_due(old_counts, new_counts, every=100) -> DataFrame:
    """Addresses whose event count crossed a multiple of ``every`` since the last
    build."""
    both = new_counts.join(old_counts.select("src_ip", c("events").alias("before")), "src_ip", "left")
    crossed = F.floor(c("events") / every) > F.floor(F.coalesce("before", F.lit(0)) / every)
    return both.where(crossed).select("src_ip", "events")
