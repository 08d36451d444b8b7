"""Aggregates, rollups, state logs, retention, listings (2.1, 2.4, 2.5, 2.6, 2.7)."""

from pyspark.sql import functions as F

from wardlight.operators import counts as K, rollups as R
from wardlight.sources import state as S, store

from .registry import AS_OF, NOW, check, define, n, ts

c = F.col


def R_(t):
    return t.rollup("agg_ip_daily")


def H_(t):
    return t.rollup("agg_threat_hourly")


define("latest_dev", "SELECT * FROM deviations QUALIFY row_number() OVER (PARTITION BY ip, type ORDER BY ts DESC, event_id DESC)=1")
define("latest_block", "SELECT * FROM blocklist QUALIFY row_number() OVER (PARTITION BY ip ORDER BY added_at DESC, event_id DESC)=1")
define("latest_score", "SELECT * FROM ml_scores QUALIFY row_number() OVER (PARTITION BY ip ORDER BY scored_at DESC, event_id DESC)=1")
define("latest_fb", "SELECT * FROM alert_feedback QUALIFY row_number() OVER (PARTITION BY entity, signature ORDER BY ts DESC, event_id DESC)=1")
define("latest_disp", "SELECT * FROM alert_feedback QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC)=1")
define("latest_run", "SELECT * FROM playbook_runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY updated_at DESC, event_id DESC)=1")


def dev(t):
    return S.latest(t.state["deviations"], "deviations", "event_id")


def blocks(t):
    return S.active_blocks(t.state["blocklist"], "event_id")


def scores(t):
    return S.latest(t.state["ml_scores"], "ml_scores", "event_id")


def disp(t):
    return S.dispositions(t.state["alert_feedback"], "event_id")


# --- sinks and retention -------------------------------------------------------

@check("o012_feedback_rows", """SELECT event_id, entity, signature, disposition, (disposition IN ('true_positive','false_positive','benign','escalate') AND (entity<>'' OR signature<>'')) AS accepted
 FROM (SELECT event_id, CASE WHEN event_id%3=0 THEN '' ELSE src_ip END AS entity,
  CASE WHEN event_id%4=0 THEN 'given' WHEN event_id%4=1 THEN threat_type||':'||rule_id ELSE '' END AS signature,
  CASE WHEN event_id%5=0 THEN 'maybe' ELSE 'benign' END AS disposition FROM logs)""")
def _(t):
    m = c("event_id")
    rows = t.logs.select("event_id", F.when(m % 3 == 0, " ").otherwise(c("src_ip")).alias("entity"),
                         F.when(m % 4 == 0, " given ").otherwise("").alias("signature"),
                         F.when(m % 4 == 1, c("threat_type")).otherwise("").alias("threat_type"),
                         F.when(m % 4 == 1, c("rule_id")).alias("rule_id"),
                         F.when(m % 5 == 0, "maybe").otherwise("benign").alias("disposition"))
    return S.feedback_rows(rows).select("event_id", "entity", "signature", "disposition", "accepted")


@check("o013_storage_statistics", "SELECT count(*) AS rows, 1::BIGINT AS files FROM events")
def _(t):
    return store.storage_statistics(t.table("events")).select("rows", "files")


@check("o014_older_than", f"SELECT count(*) AS archived FROM logs WHERE ts < {NOW} - INTERVAL 10 DAY")
def _(t):
    return store.older_than(t.logs, 10, AS_OF)


@check("o014_newer_than", f"SELECT event_id FROM logs WHERE ts >= {NOW} - INTERVAL 10 DAY")
def _(t):
    return store.newer_than(t.logs, 10, AS_OF).select("event_id")


@check("o015_kept_logs", f"SELECT event_id, {ts('t')} AS ts FROM (SELECT event_id, severity, ts - to_days(CAST(event_id%8*30 AS INTEGER)) AS t FROM logs) WHERE CASE WHEN severity IN ('low','medium','unknown','') THEN t + INTERVAL 90 DAY ELSE t + INTERVAL 180 DAY END > {NOW}")
def _(t):
    aged = t.logs.withColumn("ts", c("ts") - F.make_dt_interval((c("event_id") % 8 * 30).cast("int")))
    return store.kept_logs(aged, AS_OF).select("event_id", "ts")


@check("o015_kept_rollup", f"SELECT sum(events)::BIGINT AS events FROM (SELECT day - to_days(CAST(events*400 AS INTEGER)) AS day, events FROM agg_ip_daily) WHERE CAST(day AS TIMESTAMP) + INTERVAL 730 DAY > {NOW}")
def _(t):
    aged = R_(t).withColumn("day", F.date_sub("day", (c("events") * 400).cast("int")))
    return store.kept_rows(aged, "agg_ip_daily", AS_OF).agg(F.sum("events").alias("events"))


@check("o016_backfill_daily", "SELECT strftime(day,'%Y-%m-%d') AS day, src_ip, threat_type, severity, events FROM agg_ip_daily WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-08'")
def _(t):
    return R.backfill_daily(t.logs, "2024-01-05", "2024-01-08")


@check("o017_new_blocks", "SELECT ip, kind FROM latest_block WHERE active=1 AND ip NOT IN (SELECT src_ip FROM logs WHERE k=5)")
def _(t):
    pushed = t.logs.where("rule_id = '80005'").select(c("src_ip").alias("ip"))
    return S.new_blocks(blocks(t), pushed).select("ip", "kind")


# --- simple counts ---------------------------------------------------------------

@check("o137_recent_logs", f"""SELECT event_id, {ts('ts')} AS ts FROM logs WHERE ts >= {NOW} - INTERVAL 7 DAY AND severity IN ('high','critical') AND rule_level>=9
 AND (contains(lower(country),'us') OR contains(lower(src_ip),'us') OR contains(lower(dst_ip),'us') OR contains(lower(rule),'us') OR contains(lower(threat_type),'us') OR contains(lower(username),'us') OR contains(lower(agent),'us'))
 ORDER BY logs.ts DESC, event_id LIMIT 500""")
def _(t):
    from wardlight.operators.trails import recent_logs
    return recent_logs(t.logs, minutes=7 * 1440, severities=["high", "critical"], min_level=9, search="US", limit=500, as_of=AS_OF).select("event_id", "ts")


@check("o140_time_texts", f"SELECT event_id FROM logs WHERE ts >= TIMESTAMP '2024-01-20 10:00:00' AND ts <= TIMESTAMP '2024-01-21 10:30:00' ORDER BY ts DESC, event_id LIMIT 500")
def _(t):
    from wardlight.operators.trails import recent_logs
    return recent_logs(t.logs, start="2024-01-20T10:00", end="2024-01-21 10:30:00", limit=500).select("event_id")


@check("o301_event_counts", "SELECT src_ip, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    return K.event_counts(t.logs)


@check("o302_first_last_seen", f"SELECT src_ip, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen FROM logs GROUP BY 1")
def _(t):
    return K.first_last_seen(t.logs)


@check("o303_threat_counts", "SELECT src_ip, threat_type, count(*) AS events FROM logs GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, threat_type)<=50")
def _(t):
    return K.threat_counts(t.logs, 50)


@check("o304_severity_counts", "SELECT src_ip, severity, count(*) AS events FROM logs GROUP BY 1,2")
def _(t):
    return K.severity_counts(t.logs)


_sevs = ", ".join(f"{n(chr(115)+'everity='+repr(s))} AS {s}" for s in ("critical", "high", "medium", "low"))


@check("o305_trail_summary", f"SELECT *, critical>0 OR high>0 AS is_hot FROM (SELECT src_ip, count(*) AS total, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen, {_sevs} FROM logs GROUP BY 1)")
def _(t):
    return K.trail_summary(t.logs)


@check("o307_top_ips", "SELECT src_ip, sum(events)::BIGINT AS events FROM agg_ip_daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return K.top_ips(R_(t), 50)


@check("o308_ip_count", "SELECT count(DISTINCT src_ip) AS unique_ips FROM agg_ip_daily")
def _(t):
    return K.ip_count(R_(t))


@check("o309_hot_ips", "SELECT src_ip, sum(events)::BIGINT AS events FROM agg_ip_daily WHERE severity IN ('critical','high') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100")
def _(t):
    return K.hot_ips(R_(t), 100)


@check("o311_global_threats", "SELECT threat_type, sum(events)::BIGINT AS events FROM agg_ip_daily WHERE threat_type NOT IN ('unknown','') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return K.global_threats(R_(t), limit=50)


@check("o311_global_threats_all", "SELECT threat_type, sum(events)::BIGINT AS events FROM agg_ip_daily GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def _(t):
    return K.global_threats(R_(t), True, 50)


@check("o312_global_severities", "SELECT severity, sum(events)::BIGINT AS events FROM agg_ip_daily GROUP BY 1")
def _(t):
    return K.global_severities(R_(t))


@check("o313_technique_counts", f"SELECT x AS technique, count(*) AS events FROM (SELECT unnest(string_split_regex(upper(mitre),'[,\\s]+')) AS x FROM logs WHERE mitre<>'' AND ts >= {NOW} - INTERVAL 90 DAY) WHERE x<>'' GROUP BY 1")
def _(t):
    return K.technique_counts(t.logs, 90, AS_OF, t.rollup("agg_technique_daily"))


@check("o314_ips_with_prefix", "SELECT src_ip, sum(events)::BIGINT AS events FROM agg_ip_daily WHERE starts_with(src_ip,'10.1') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return K.ips_with_prefix(R_(t), "10.1", 20)


@check("o315_top_users", "SELECT username, count(*) AS events FROM logs WHERE username<>'' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def _(t):
    return K.top_values(t.logs, "username", 200)


@check("o315_top_hosts", "SELECT agent, count(*) AS events FROM logs WHERE agent<>'' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def _(t):
    return K.top_values(t.logs, "agent", 200)


@check("o316_user_countries", "SELECT DISTINCT username, country FROM logs WHERE country<>'' AND username<>''")
def _(t):
    return K.user_countries(t.logs)


ENTITY_AGG = lambda col: f"SELECT {col} AS entity, count(*) AS events, {n(chr(115)+'everity='+repr('critical'))} AS crit, count(DISTINCT dst_ip) AS dsts, count(DISTINCT dst_port) AS ports, count(DISTINCT country) AS countries, count(DISTINCT src_ip) AS srcs FROM logs WHERE {col}<>'' GROUP BY 1"


@check("o317_entity_aggregates", ENTITY_AGG("username"))
def _(t):
    return K.entity_aggregates(t.logs)


_dims = " UNION ALL ".join(f"SELECT username AS entity, '{d}' AS dimension, {v} AS value, ts FROM logs WHERE username<>'' {w}" for d, v, w in
                           [("total", "''", ""), ("threat_type", "threat_type", ""), ("severity", "severity", ""), ("src_ip", "src_ip", "AND src_ip<>''"), ("username", "username", "")])


@check("o318_entity_summary", f"SELECT entity, dimension, value, count(*) AS events, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen FROM ({_dims}) GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY entity, dimension ORDER BY count(*) DESC, value)<=50")
def _(t):
    return K.entity_summary(t.logs, "username")


@check("o320_threat_recurrence", f"""SELECT threat_type, count(*) AS events, count(DISTINCT src_ip) AS ips, max(rule_level) AS max_lvl, {n("severity IN ('high','critical')")} AS hi,
 {n("severity='critical'")} AS crit, date_diff('day', min(ts), max(ts))+1 AS span_days, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen
 FROM logs WHERE ts >= {NOW} - INTERVAL 30 DAY AND threat_type<>'' GROUP BY 1""")
def _(t):
    return K.threat_recurrence(t.logs, 30, AS_OF)


@check("o322_hourly_trend", f"SELECT {ts('hour')} AS hour, sum(events)::BIGINT AS total, coalesce(sum(events) FILTER (WHERE severity IN ('high','critical')),0)::BIGINT AS hot FROM agg_threat_hourly WHERE agg_threat_hourly.hour >= {NOW} - INTERVAL 24 HOUR GROUP BY agg_threat_hourly.hour")
def _(t):
    return K.hourly_trend(H_(t), 24, AS_OF)


@check("o323_blast_radius", f"""SELECT 'net:'||net AS incident_id, count(DISTINCT agent) AS hosts, count(DISTINCT nullif(username,'')) AS users, count(DISTINCT dst_ip) AS dst_ips,
 count(*) AS events, {n(f"ts >= {NOW} - INTERVAL 24 HOUR")} AS events_24h FROM (SELECT *, array_to_string(string_split(src_ip,'.')[1:3],'.') AS net FROM logs) GROUP BY net""")
def _(t):
    from wardlight.functions.columns import subnet24
    members = t.logs.select(F.concat(F.lit("net:"), subnet24(c("src_ip"))).alias("incident_id"), c("src_ip").alias("ip")).distinct()
    return K.blast_radius(members, t.logs, AS_OF)


@check("o327_alert_counts", f"SELECT ip, count(*) AS baseline_alerts, {n(chr(115)+'everity='+repr('critical'))} AS critical_alerts FROM latest_dev GROUP BY 1")
def _(t):
    return K.alert_counts(dev(t))


@check("o328_alert_type_counts", "SELECT type, count(*) AS alerts FROM latest_dev GROUP BY 1")
def _(t):
    return K.alert_type_counts(dev(t))


@check("o328_alert_totals", "SELECT count(*) AS alerts, count(DISTINCT CASE WHEN severity='critical' THEN ip END) AS critical_ips FROM latest_dev")
def _(t):
    return K.alert_totals(dev(t))


@check("o331_subnet_clusters", """SELECT subnet24, count(*) AS ip_count, sum(events)::BIGINT AS total_events, sum(coalesce(alerts,0))::BIGINT AS total_alerts,
 CASE WHEN sum(events)>500 THEN 'critical' WHEN sum(events)>100 THEN 'high' ELSE 'medium' END AS threat_level
 FROM (SELECT src_ip, array_to_string(string_split(src_ip,'.')[1:3],'.') AS subnet24, count(*) AS events FROM logs GROUP BY 1,2)
 LEFT JOIN (SELECT ip, count(*) AS alerts FROM latest_dev GROUP BY 1) ON ip=src_ip GROUP BY 1 HAVING count(*)>1""")
def _(t):
    return K.subnet_clusters(R_(t), dev(t))


@check("o332_deviation_summaries", f"""SELECT d.ip, count(*) AS alert_count, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 5 WHEN 'medium' THEN 2 ELSE 1 END)::BIGINT AS deviation_score,
 array_to_string(list_sort(list(DISTINCT type)), ',') AS alert_types, array_to_string(list(type ORDER BY ts DESC, type)[1:10], ',') AS newest
 FROM latest_dev d GROUP BY 1""")
def _(t):
    out = K.deviation_summaries(dev(t))
    return out.select("ip", "alert_count", "deviation_score", F.array_join("alert_types", ",").alias("alert_types"),
                      F.array_join(F.transform("alerts", lambda a: a.type), ",").alias("newest"))


@check("o333_audit_summary", f"SELECT username, {n(chr(97)+'ction='+repr('login'))} AS logins, {n(chr(97)+'ction='+repr('login_failed'))} AS failures, {ts('max(ts) FILTER (WHERE action=' + repr('login') + ')')} AS last_login, {ts('min(ts) FILTER (WHERE action=' + repr('login') + ')')} AS first_login FROM auth_audit GROUP BY 1")
def _(t):
    return S.audit_summary(t.state["auth_audit"])


# --- newest state ------------------------------------------------------------------

@check("o401_latest_deviations", f"SELECT ip, type, severity, message, {ts('ts')} AS ts FROM latest_dev")
def _(t):
    return dev(t).select("ip", "type", "severity", "message", "ts")


@check("o401_active_blocks", "SELECT ip, kind FROM latest_block WHERE active=1")
def _(t):
    return blocks(t).select("ip", "kind")


@check("o401_active_tags", "SELECT entity, tag FROM entity_tags QUALIFY row_number() OVER (PARTITION BY entity, tag ORDER BY added_at DESC, event_id DESC)=1 AND active=1")
def _(t):
    return S.active_tags(t.state["entity_tags"], "event_id").select("entity", "tag")


@check("o401_dispositions", f"SELECT entity, disposition, {ts('ts')} AS ts FROM latest_disp")
def _(t):
    return disp(t).select("entity", "disposition", "ts")


@check("o402_score_list", f"SELECT ip, risk_score, anomaly_score, is_anomaly, {ts('scored_at')} AS scored_at FROM latest_score ORDER BY risk_score DESC, ip LIMIT 100")
def _(t):
    return S.score_list(t.state["ml_scores"], 100, tiebreak="event_id").select("ip", "risk_score", "anomaly_score", "is_anomaly", "scored_at")


@check("o402_anomalies", "SELECT ip, risk_score FROM latest_score WHERE is_anomaly ORDER BY risk_score DESC, ip LIMIT 500")
def _(t):
    return S.score_list(t.state["ml_scores"], 500, True, "event_id").select("ip", "risk_score")


@check("o402_key_count", "SELECT count(DISTINCT ip) AS keys FROM ml_scores")
def _(t):
    return S.key_count(t.state["ml_scores"])


@check("o402_run_list", "SELECT run_id, incident_id, status FROM latest_run ORDER BY updated_at DESC, run_id LIMIT 50")
def _(t):
    return S.run_list(t.state["playbook_runs"], limit=50, tiebreak="event_id").select("run_id", "incident_id", "status")


@check("o402_feedback_list", "SELECT entity, signature, disposition FROM latest_fb ORDER BY ts DESC, entity, signature LIMIT 200")
def _(t):
    return S.feedback_list(t.state["alert_feedback"], 200, tiebreak="event_id").select("entity", "signature", "disposition")


@check("o403_label_examples", f"""SELECT threat_type, entity, events, max_lvl, crit, uniq_dst FROM (SELECT threat_type, src_ip AS entity, count(*) AS events, max(rule_level) AS max_lvl,
 {n("severity='critical'")} AS crit, count(DISTINCT dst_ip) AS uniq_dst, row_number() OVER (PARTITION BY threat_type ORDER BY count(*) DESC, src_ip) AS rn
 FROM logs WHERE threat_type<>'' AND src_ip<>'' AND src_ip NOT IN (SELECT entity FROM latest_disp WHERE disposition='benign') AND ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1,2) WHERE rn=1""")
def _(t):
    from wardlight.operators.recommend import label_examples
    return label_examples(t.logs, disp(t).where("disposition = 'benign'"), 30, AS_OF)


@check("o453_newest_alerts", f"SELECT ip, type, severity, {ts('ts')} AS ts FROM (SELECT * FROM deviations WHERE severity='critical' QUALIFY row_number() OVER (PARTITION BY ip, type ORDER BY deviations.ts DESC, event_id DESC)=1) d ORDER BY d.ts DESC, ip, type LIMIT 100")
def _(t):
    return S.newest_alerts(t.state["deviations"], 100, "critical", tiebreak="event_id").select("ip", "type", "severity", "ts")


@check("o454_audit_list", f"SELECT username, action, client_ip, {ts('ts')} AS ts FROM auth_audit a WHERE action='login_failed' ORDER BY a.ts DESC, event_id LIMIT 300")
def _(t):
    return S.audit_list(t.state["auth_audit"], 300, action="login_failed").select("username", "action", "client_ip", "ts")


@check("o455_active_ips", f"SELECT DISTINCT src_ip FROM logs WHERE ts > {NOW} - INTERVAL 24 HOUR AND src_ip<>''")
def _(t):
    return K.active_ips(t.logs, AS_OF)


# --- ordered listings -----------------------------------------------------------------

@check("o404_gap_statistics", "SELECT src_ip, count(g) AS gaps, round(avg(g),3) AS mean_gap, round(min(g),3) AS min_gap, round(stddev_pop(g),3) AS std_gap FROM (SELECT src_ip, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip ORDER BY ts, event_id))/1e6 AS g FROM plogs) GROUP BY 1")
def _(t):
    from wardlight.functions.times import seconds
    from wardlight.operators.sequence import gap_statistics
    g = gap_statistics(t.plogs, ["src_ip"], seconds(c("ts")))
    return g.select("src_ip", "gaps", *[F.round(x, 3).alias(x) for x in ("mean_gap", "min_gap", "std_gap")])


@check("o416_first_occurrence", f"SELECT src_ip, dst_port AS port, count(*) AS events, {ts('min(ts)')} AS first_seen, row_number() OVER (PARTITION BY src_ip ORDER BY min(ts), dst_port) AS rank FROM logs WHERE dst_port<>'' GROUP BY 1,2 QUALIFY rank<=15")
def _(t):
    from wardlight.operators.killchain import port_sequence
    return port_sequence(t.logs).select("src_ip", "port", "events", "first_seen", "rank")


@check("o417_top_per_group", "SELECT username, dst_ip, count(*) AS events FROM logs GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY username ORDER BY count(*) DESC, dst_ip)<=8")
def _(t):
    from wardlight.operators.sequence import top_per
    return top_per(t.logs.groupBy("username", "dst_ip").agg(F.count(F.lit(1)).alias("events")), ["username"], [F.desc("events"), "dst_ip"], 8)


@check("o451_newest_per_entity", f"SELECT src_ip, event_id, {ts('ts')} AS ts FROM logs QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY logs.ts DESC, event_id DESC)<=20")
def _(t):
    from wardlight.operators.trails import newest_per
    return newest_per(t.logs, "src_ip", 20).select("src_ip", "event_id", "ts")


@check("o451_entity_trail", f"SELECT event_id, {ts('ts')} AS ts FROM logs WHERE username='user7' ORDER BY logs.ts DESC, event_id DESC LIMIT 200")
def _(t):
    from wardlight.operators.trails import trail
    return trail(t.logs, "username", "user7", 200).select("event_id", "ts")


@check("o452_login_events", "SELECT event_id, username FROM logs WHERE threat_type IN ('login_success','brute_force','ssh_bruteforce','vpn_bruteforce','rdp_relay') AND username<>''")
def _(t):
    from wardlight.operators.trails import login_events
    return login_events(t.logs).select("event_id", "username")


# --- rollups ----------------------------------------------------------------------------

@check("o501_daily_rollup", "SELECT strftime(day,'%Y-%m-%d') AS day, src_ip, threat_type, severity, events FROM agg_ip_daily")
def _(t):
    return R.summed(R_(t), R.DAILY_KEYS)


@check("o502_hourly_rollup", f"SELECT {ts('hour')} AS hour, threat_type, severity, events FROM agg_threat_hourly")
def _(t):
    return R.summed(H_(t), R.HOURLY_KEYS)


FS = " UNION ALL ".join(f"SELECT '{k}' AS kind, {key} AS key, ts FROM plogs WHERE {w}" for k, key, w in [
    ("user_host", "username||'|'||agent", "username<>'' AND agent<>'' AND NOT ends_with(username,'$') AND lower(username)<>lower(agent)"),
    ("binary", "proc_image", "proc_image<>''"), ("binary_host", "proc_image||'|'||agent", "proc_image<>'' AND agent<>''"),
    ("agent", "agent", "agent<>''"), ("country", "country", "country<>''"), ("port", "dst_port", "dst_port<>''")])
define("ledger", f"SELECT kind, key, min(ts) AS first_ts, count(*) AS events FROM ({FS}) GROUP BY 1,2")


@check("o503_first_seen_ledger", f"SELECT kind, key, {ts('first_ts')} AS first_ts, events FROM ledger")
def _(t):
    return R.merged_first_seen(R.first_seen(t.plogs))


@check("o461_ledger_kinds", "SELECT kind, count(*) AS keys, sum(events)::BIGINT AS events FROM ledger GROUP BY 1")
def _(t):
    return R.first_seen(t.plogs).groupBy("kind").agg(F.count(F.lit(1)).alias("keys"), F.sum("events").alias("events"))


def _within(estimates, exact, *keys):
    """Whether stored sketches, united over all days, keep their stated error."""
    near = lambda x: F.abs(c(x) - c(f"exact_{x}")) <= F.greatest(F.lit(1.0), c(f"exact_{x}") * R.sketch_error())
    both = estimates.join(exact, list(keys))
    return both.select(*keys, near("ips").alias("ips_within"), near("users").alias("users_within"))


@check("o340_approximate_distinct", "SELECT threat_type, true AS ips_within, true AS users_within FROM logs GROUP BY 1")
def _(t):
    exact = t.logs.groupBy("threat_type").agg(F.countDistinct("src_ip").alias("exact_ips"), F.countDistinct(F.nullif("username", F.lit(""))).alias("exact_users"))
    return _within(R.sketched(t.rollup("agg_sketch_daily"), "threat_type"), exact, "threat_type")


@check("o340_preset_accounts", "SELECT username AS account, true AS near FROM logs WHERE ts >= " + NOW + " - INTERVAL 7 DAY AND username<>'' GROUP BY 1")
def _(t):
    from wardlight.plans.presets import targeted_accounts
    about, exact = (targeted_accounts(t.logs, 7, None, AS_OF, exact=e).select("account", "source_ips") for e in (False, True))
    return about.join(exact.withColumnRenamed("source_ips", "all_ips"), "account").select(
        "account", (F.abs(c("source_ips") - c("all_ips")) <= F.greatest(F.lit(1.0), c("all_ips") * 0.15)).alias("near"))


@check("o308_sketched_count", "SELECT true AS near FROM logs HAVING count(*) > 0")
def _(t):
    days = t.rollup("agg_sketch_daily")
    exact = K.ip_count(R_(t)).scalar()
    return R.sketched(days).select((F.abs(c("ips") - exact) <= F.greatest(F.lit(1.0), exact * R.sketch_error())).alias("near"))


@check("o201_hot_ip_details", """WITH hot AS (SELECT src_ip, sum(events)::BIGINT AS total FROM agg_ip_daily WHERE severity IN ('critical','high') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30)
 SELECT h.src_ip, h.total, threat_type, severity, sum(events)::BIGINT AS events FROM hot h JOIN agg_ip_daily a ON a.src_ip=h.src_ip GROUP BY ALL""")
def _(t):
    from wardlight.operators.trails import hot_ip_cells
    return hot_ip_cells(R_(t), 30)


@check("o203_scores_not_blocked", "SELECT ip, risk_score FROM latest_score WHERE risk_score>=50 AND ip NOT IN (SELECT ip FROM latest_block WHERE active=1) ORDER BY risk_score DESC, ip LIMIT 200")
def _(t):
    from wardlight.plans.presets import risky_not_blocked
    return risky_not_blocked(scores(t), blocks(t)).select("ip", "risk_score")


@check("o214_neighbours", """SELECT a.src_ip, b.src_ip AS related_ip, b.events AS related_events, row_number() OVER (PARTITION BY a.src_ip ORDER BY b.events DESC, b.src_ip) AS rank
 FROM (SELECT src_ip, array_to_string(string_split(src_ip,'.')[1:3],'.') AS net FROM logs GROUP BY 1,2) a JOIN (SELECT src_ip, array_to_string(string_split(src_ip,'.')[1:3],'.') AS net, count(*) AS events FROM logs GROUP BY 1,2) b
 ON a.net=b.net AND a.src_ip<>b.src_ip QUALIFY rank<=6""")
def _(t):
    return K.neighbours(R_(t))


# --- hot addresses, presets, panels --------------------------------------------------------

@check("o310_hot_ip_summaries", f"""WITH hot AS (SELECT src_ip, sum(events)::BIGINT AS total FROM agg_ip_daily WHERE severity IN ('critical','high') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30),
 who AS (SELECT src_ip, u, agent AS h, count(*) AS n FROM (SELECT l.src_ip, agent, CASE WHEN username<>'' AND NOT ends_with(username,'$') AND lower(username)<>lower(agent) THEN username
   WHEN target_user<>'' AND NOT ends_with(target_user,'$') AND lower(target_user)<>lower(agent) THEN target_user END AS u FROM logs l JOIN hot USING (src_ip)) GROUP BY ALL),
 us AS (SELECT src_ip, count(*) AS user_count, list(u||':'||n ORDER BY n DESC, u)[1:8] AS users, first(u ORDER BY n DESC, u) AS top_u FROM (SELECT src_ip, u, sum(n)::BIGINT AS n FROM who WHERE u IS NOT NULL GROUP BY 1,2) GROUP BY 1),
 hs AS (SELECT src_ip, count(*) AS host_count, list(h||':'||n ORDER BY n DESC, h)[1:8] AS hosts, first(h ORDER BY n DESC, h) AS top_h FROM (SELECT src_ip, h, sum(n)::BIGINT AS n FROM who WHERE h<>'' GROUP BY 1,2) GROUP BY 1)
 SELECT hot.src_ip, hot.total, coalesce(user_count,0) AS user_count, coalesce(host_count,0) AS host_count, array_to_string(users,',') AS users, array_to_string(hosts,',') AS hosts,
  coalesce(top_u, top_h, hot.src_ip) AS identity, CASE WHEN top_u IS NOT NULL THEN 'user' WHEN top_h IS NOT NULL THEN 'host' ELSE 'ip' END AS identity_kind,
  t.total_all, t.malware, t.crit FROM hot LEFT JOIN us USING (src_ip) LEFT JOIN hs USING (src_ip)
  LEFT JOIN (SELECT src_ip, count(*) AS total_all, {n("threat_type='malware'")} AS malware, {n("severity='critical'")} AS crit FROM logs GROUP BY 1) t USING (src_ip)""")
def _(t):
    from wardlight.operators.trails import hot_ip_summaries
    out = hot_ip_summaries(R_(t), t.logs)
    text = lambda col: F.array_join(F.transform(col, lambda x: F.concat(x["name"], F.lit(":"), x["events"].cast("string"))), ",")
    return out.select("src_ip", "total", "user_count", "host_count", text("users").alias("users"), text("hosts").alias("hosts"), "identity", "identity_kind",
                      "total_all", F.coalesce(c("threat_types")["malware"], F.lit(0)).alias("malware"), F.coalesce(c("severities")["critical"], F.lit(0)).alias("crit"))


@check("o635_outside_brute_force", f"SELECT {ts('ts')} AS ts, src_ip, country, threat_type, severity, rule FROM logs WHERE threat_type ILIKE '%brute%' AND country NOT IN ('India','') AND src_ip NOT LIKE '10.%' AND src_ip NOT LIKE '192.168.%' AND logs.ts >= (SELECT max(ts) FROM logs) - INTERVAL 6 HOUR ORDER BY logs.ts DESC, event_id LIMIT 200")
def _(t):
    from wardlight.plans import presets as P
    return P.outside_brute_force(t.logs)


@check("o636_busiest_ips", f"SELECT src_ip, count(*) AS events, {n(chr(115)+'everity='+repr('critical'))} AS critical, count(DISTINCT threat_type) AS threat_types FROM logs WHERE ts >= (SELECT max(ts) FROM logs) - INTERVAL 24 HOUR GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    from wardlight.plans import presets as P
    return P.busiest_ips(t.logs)


@check("o637_lateral_events", f"SELECT {ts('ts')} AS ts, src_ip, dst_ip, threat_type, severity, rule FROM logs WHERE threat_type IN ('rdp_relay','privilege_escalation') AND logs.ts >= (SELECT max(ts) FROM logs) - INTERVAL 24 HOUR ORDER BY logs.ts DESC, event_id LIMIT 200")
def _(t):
    from wardlight.plans import presets as P
    return P.lateral_events(t.logs)


@check("o638_targeted_accounts", f"SELECT username AS account, count(*) AS events, count(DISTINCT src_ip) AS source_ips, {n(chr(115)+'everity IN (' + repr('critical') + ',' + repr('high') + ')')} AS high_severity FROM logs WHERE username<>'' AND ts >= (SELECT max(ts) FROM logs) - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    from wardlight.plans import presets as P
    return P.targeted_accounts(t.logs)


@check("o639_risky_not_blocked", "SELECT ip, risk_score, is_anomaly FROM latest_score WHERE risk_score>=50 AND ip NOT IN (SELECT ip FROM latest_block WHERE active=1) ORDER BY risk_score DESC, ip LIMIT 200")
def _(t):
    from wardlight.plans.presets import risky_not_blocked
    return risky_not_blocked(scores(t), blocks(t))


@check("o640_hot_last_hour", f"SELECT {ts('ts')} AS ts, src_ip, country, threat_type, severity, rule FROM logs WHERE severity IN ('critical','high') AND logs.ts >= (SELECT max(ts) FROM logs) - INTERVAL 1 HOUR ORDER BY logs.ts DESC, event_id LIMIT 200")
def _(t):
    from wardlight.plans import presets as P
    return P.hot_last_hour(t.logs)


_PANEL = "FROM logs WHERE logs.ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND severity IN ('high','critical') AND threat_type IN ('malware','db_scan','ssh_bruteforce') AND (rule ILIKE '%a%' OR src_ip ILIKE '%a%' OR threat_type ILIKE '%a%')"


def _panel(t):
    from wardlight.plans import presets as P
    return P.panel_rows(t.logs, "2024-01-10", "2024-01-12", ["high", "critical"], ["malware", "db_scan", "ssh_bruteforce"], "A")


@check("o339_panel_count", f"SELECT count(*) AS c {_PANEL}")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_count(_panel(t))


@check("o339_panel_critical", f"SELECT count(*) AS c {_PANEL} AND severity='critical'")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_critical(_panel(t))


@check("o339_panel_unique_ips", f"SELECT count(DISTINCT src_ip) AS c {_PANEL}")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_unique_ips(_panel(t))


@check("o339_panel_freshness", f"SELECT date_diff('second', max(ts), {NOW}) AS s FROM logs")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_freshness(t.logs, AS_OF)


@check("o339_panel_series", f"SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S.%f') AS time, severity, count(*) AS events {_PANEL} GROUP BY ALL")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_series(_panel(t))


@check("o339_panel_table", f"SELECT {ts('ts')} AS ts, src_ip, dst_ip, dst_port, threat_type, severity, rule_level, country, agent, rule {_PANEL} ORDER BY logs.ts DESC, event_id LIMIT 1000")
def _(t):
    from wardlight.plans import presets as P
    return P.panel_table(_panel(t))
