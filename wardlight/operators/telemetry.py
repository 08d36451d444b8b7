"""Health and drift of the telemetry itself."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, moment, since, span_text
from .sequence import gap_statistics

c = F.col


# --- silent agents ------------------------------------------------------------

def agent_activity(logs, days=14, least=10, as_of=None) -> DataFrame:
    """Totals, first and last event and last-day events of every reporting agent."""
    now = moment(as_of, logs)
    rows = since(logs, ago(now, days=days)).where("agent != ''")
    return rows.groupBy("agent").agg(
        row_count("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        F.count_if(c("ts") >= ago(now, days=1)).alias("last24")).where(c("total") >= least)


def hour_gaps(logs, days=14, as_of=None) -> DataFrame:
    """Mean and longest pause between active hours (one hour when only one)."""
    now = moment(as_of, logs)
    hours = (since(logs, ago(now, days=days)).where("agent != ''")
             .select("agent", F.date_trunc("hour", "ts").alias("hour")).distinct())
    gap = F.unix_seconds("hour") - F.lag(F.unix_seconds("hour")).over(W.partitionBy("agent").orderBy("hour"))
    return hours.withColumn("gap", gap).groupBy("agent").agg(
        F.coalesce(F.avg("gap"), F.lit(3600.0)).alias("avg_gap"),
        F.coalesce(F.max("gap"), F.lit(3600)).alias("max_gap"), row_count("active_hours"))


def silence_report(logs, days=14, least=10, as_of=None) -> DataFrame:
    """Agents quiet for longer than their own history explains, or far below their
    usual volume."""
    now = moment(as_of, logs)
    both = agent_activity(logs, days, least, as_of).join(hour_gaps(logs, days, as_of), "agent")
    secs = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6
    rows = both.withColumns({
        "expected": F.greatest(c("avg_gap") * 3, c("max_gap") * 1.5, F.lit(3600.0)),
        "quiet": secs(c("last_ts"), now),
        "avg_day": c("total") / F.greatest(F.lit(1.0), secs(c("first_ts"), now) / 86400)})
    drop = F.when(c("avg_day") >= 5, F.rint(F.greatest(F.lit(0.0), 1 - c("last24") / c("avg_day")) * 100)) \
        .otherwise(0.0).cast("long")
    status = (F.when(c("quiet") > c("expected") * 2, "silent_critical").when(c("quiet") > c("expected"), "silent")
              .when(c("drop_pct") >= 75, "degraded").otherwise("ok"))
    return (rows.withColumn("drop_pct", drop).withColumn("status", status).select(
        "agent", "status", c("last_ts").alias("last_seen"), c("quiet").cast("long").alias("quiet_seconds"),
        span_text(c("quiet")).alias("quiet_for"), span_text(c("expected")).alias("expected_max_gap"),
        c("total").alias("events_total"), c("last24").alias("events_24h"),
        F.bround("avg_day", 1).alias("avg_per_day"), "drop_pct"))


def silence_summary(report) -> DataFrame:
    count = lambda *names: F.count_if(c("status").isin(*names))
    return report.agg(row_count("total"), count("silent", "silent_critical").alias("silent"),
                      count("degraded").alias("degraded"), count("ok").alias("ok"))


# --- new things ------------------------------------------------------------------

def novelties(ledger, days=7, as_of=None) -> DataFrame:
    """Keys of the first-seen ledger that first appeared in the window."""
    fresh = ledger.where((c("kind") != "binary_host") & (c("first_ts") >= ago(moment(as_of, ledger, "first_ts"), days=days)))
    part = lambda i: F.split_part("key", F.lit("|"), F.lit(i))
    pair = c("kind") == "user_host"
    return fresh.select("kind", "key", F.when(pair, part(1)).otherwise(c("key")).alias("subject"),
                        F.when(pair, part(2)).otherwise("").alias("agent"), "first_ts", "events")


def rare_binaries(ledger, most=2) -> DataFrame:
    """Programs that ran on very few machines."""
    return (ledger.where("kind = 'binary_host'")
            .groupBy(F.split_part("key", F.lit("|"), F.lit(1)).alias("proc_image"))
            .agg(row_count("on_agents"), F.sum("events").alias("runs"), F.min("first_ts").alias("first_ts"))
            .where(c("on_agents") <= most))


def first_seen_summary(ledger, days=7, as_of=None) -> DataFrame:
    """Learning mode (history under two windows), novelties and rare binaries."""
    now = moment(as_of, ledger, "first_ts")
    fresh = (c("kind") != "binary_host") & (c("first_ts") >= ago(now, days=days))
    history = (F.unix_micros(now) - F.unix_micros(F.min("first_ts"))) / 1e6 / 86400
    rare = rare_binaries(ledger).agg(row_count("n")).scalar()
    return ledger.agg(F.min("first_ts").alias("history_from"), (history < days * 2).alias("learning_mode"),
                      F.count_if(fresh).alias("novelties")).withColumn("rare_binaries", rare)


# --- beacons ---------------------------------------------------------------------

FLOW = ["src_ip", "dst_ip", "dst_port"]


def busy_flows(logs, hours=24, least=12, as_of=None) -> DataFrame:
    """Rows of the flows with enough hits to judge their timing.  The count comes
    first and is cheap; only rows of surviving flows are ordered."""
    rows = since(logs, ago(moment(as_of, logs), hours=hours)).where("src_ip != '' and dst_ip != ''")
    flows = rows.groupBy(*FLOW).agg(row_count("hits")).where(c("hits") >= least)
    return rows.join(flows.select(*FLOW), FLOW, "left_semi")


def flow_timing(rows) -> DataFrame:
    """Mean gap (1 decimal) and coefficient of variation (3 decimals) per flow, over
    whole seconds."""
    gaps = gap_statistics(rows, FLOW, F.unix_seconds(F.date_trunc("second", "ts")))
    cv = F.when(c("mean_gap") > 0, c("std_gap") / c("mean_gap")).otherwise(999.0)
    return gaps.select(*FLOW, F.round("mean_gap", 1).alias("period_s"), F.round(cv, 3).alias("cv"))


def beacon_report(logs, hours=24, least=12, as_of=None) -> DataFrame:
    """Flows with machine-regular timing, scored and judged."""
    rows = busy_flows(logs, hours, least, as_of)
    facts = rows.groupBy(*FLOW).agg(
        row_count("hits"), F.count_if(C.is_allowed(c("action"))).alias("allowed_hits"),
        F.count_if(C.is_blocked(c("action"))).alias("blocked_hits"), F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"), F.coalesce(F.min(F.nullif("country", F.lit(""))), F.lit("")).alias("country"),
        F.coalesce(F.min(F.nullif("agent", F.lit(""))), F.lit("")).alias("agent"))
    score = F.rint(F.greatest(F.lit(0.0), 1 - c("cv") / 0.35) * 70 + F.least(F.lit(30.0), c("hits") / 4)).cast("long")
    infra = c("dst_port").isin(X.INFRA_PORTS)
    verdict = (F.when(infra, "infrastructure").when(c("allowed_hits") >= c("blocked_hits"), "beacon_allowed")
               .otherwise("beacon_blocked"))
    regular = c("period_s").between(5, 3600) & (c("cv") < 0.35)
    return (facts.join(flow_timing(rows), FLOW).where(regular)
            .withColumns({"score": score, "likely_infra": infra, "verdict": verdict,
                          "period": span_text(c("period_s"))}))


# --- firewall policies --------------------------------------------------------------

def policy_rows(logs, days=7, as_of=None) -> DataFrame:
    """Firewall rows with their policy.  The cheap test is a filter below the
    extraction, so text is only parsed on the rows it keeps."""
    rows = since(logs, ago(moment(as_of, logs), days=days)).where(
        C.is_firewall_row(c("decoder"), c("rule_groups"), c("rule"), c("location")))
    pid = C.policy_of(c("policy_id"), c("raw"), c("full_log"))
    return rows.select("ts", "action", "src_ip", "dst_ip", "country", pid.alias("policy")).where("policy != ''")


def policy_aggregates(logs, days=7, as_of=None) -> DataFrame:
    """Hits, outcome, breadth and countries (known ones, before and within the last
    day) per policy."""
    new = c("ts") >= ago(moment(as_of, logs), days=1)
    country = F.nullif("country", F.lit(""))
    return policy_rows(logs, days, as_of).groupBy("policy").agg(
        row_count("hits"), F.count_if(C.is_allowed(c("action"))).alias("allowed"),
        F.count_if(C.is_blocked(c("action"))).alias("blocked"), F.count_if(new).alias("hits_24h"),
        F.countDistinct("src_ip").alias("src_count"), F.countDistinct("dst_ip").alias("dst_count"),
        F.array_sort(F.collect_set(F.when(new, country))).alias("countries_24h"),
        F.array_sort(F.collect_set(F.when(~new, country))).alias("countries_before"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def policy_report(logs, days=7, as_of=None) -> DataFrame:
    """Policies with surge factor, new countries and whether they went quiet."""
    prior = (c("hits") - c("hits_24h")) / F.lit(max(1, days - 1))
    surge = F.when(c("prior_avg") >= 5, F.bround(c("hits_24h") / c("prior_avg"), 1)).otherwise(0.0)
    return (policy_aggregates(logs, days, as_of).withColumn("prior_avg", prior).withColumn("surge", surge)
            .withColumns({"surge_x": F.when(c("surge") >= 3, c("surge")).otherwise(0.0),
                          "new_countries_24h": F.array_except("countries_24h", "countries_before"),
                          "went_quiet": (c("prior_avg") >= 20) & (c("hits_24h") == 0)})
            .drop("surge", "countries_24h", "countries_before"))


def policy_findings(report) -> DataFrame:
    """One row per drift: surge, new_country or went_quiet."""
    text = lambda x: x.cast("string")
    found = F.array(
        F.when(c("surge_x") >= 3, F.struct(F.lit("surge").alias("kind"), text(c("surge_x")).alias("detail"))),
        F.when(F.size("new_countries_24h") > 0, F.struct(
            F.lit("new_country").alias("kind"), F.array_join(F.slice("new_countries_24h", 1, 5), ", ").alias("detail"))),
        F.when(c("went_quiet"), F.struct(F.lit("went_quiet").alias("kind"), text(c("prior_avg").cast("long")).alias("detail"))))
    return (report.select("policy", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
            .select("policy", "f.*"))


# --- blind spots --------------------------------------------------------------------

def agent_coverage(logs) -> DataFrame:
    """Process, authentication, file and technique events of every agent."""
    has = lambda col, w: F.lower(col).contains(w)
    count = lambda cond, name: F.count_if(cond).alias(name)
    return logs.where("agent != ''").groupBy("agent").agg(
        row_count("total"), count((c("proc_image") != "") | (c("proc_cmdline") != ""), "process"),
        count((c("logon_type") != "") | has("rule_groups", "authentication") | has("rule", "logon")
              | has("rule", "login"), "auth"),
        count(has("rule_groups", "syscheck") | (c("sc_path") != ""), "fim"),
        count((c("mitre") != "") | (c("mitre_technique") != ""), "mitre"), F.max("ts").alias("last_seen"))


def coverage_report(logs) -> DataFrame:
    gap = lambda name: F.when(c(name) == 0, name)
    gaps = F.filter(F.array(gap("process"), gap("auth"), gap("fim")), lambda g: g.isNotNull())
    return agent_coverage(logs).withColumn("gaps", gaps)


def coverage_summary(report) -> DataFrame:
    blind = F.size("gaps") > 0
    return report.agg(row_count("agents"), F.count_if(blind).alias("with_gaps"),
                      F.count_if(~blind).alias("fully_covered"))


def tactic_volumes(logs) -> DataFrame:
    fields = logs.where("mitre_tactic != ''").groupBy("mitre_tactic").agg(row_count("events"))
    return (fields.select(F.explode(F.split("mitre_tactic", ",")).alias("part"), "events")
            .select(F.trim("part").alias("tactic"), "events")
            .where("tactic != ''").groupBy("tactic").agg(F.sum("events").alias("events")))


def telemetry_summary(logs, ledger, as_of=None) -> DataFrame:
    """Headline numbers of all telemetry reports, as one row of scalar subqueries."""
    one = lambda df, col: df.select(col).scalar()
    silence = silence_summary(silence_report(logs, as_of=as_of))
    return first_seen_summary(ledger, as_of=as_of).select(
        one(silence, c("silent") + c("degraded")).alias("silent_agents"),
        one(silence, c("total")).alias("agents_total"),
        c("novelties").alias("novelties_7d"), "learning_mode",
        one(beacon_report(logs, as_of=as_of).where("not likely_infra").agg(row_count("n")), c("n")).alias("beacons"),
        one(policy_findings(policy_report(logs, as_of=as_of)).agg(row_count("n")), c("n")).alias("policy_findings"),
        one(coverage_summary(coverage_report(logs)), c("with_gaps")).alias("blind_agents"))
