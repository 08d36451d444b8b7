"""Feature vectors, baselines, deviations, takeover, travel, user risk."""

from pyspark.sql import functions as F

from wardlight.functions import fixed as X
from wardlight.operators import baseline as B, counts as K, features as FE, takeover as TO, travel as TR, users as U
from wardlight.operators.trails import login_events

from .count_checks import ENTITY_AGG, dev
from .function_checks import CENTROIDS, _HAV
from .registry import AS_OF, NOW, check, define, n, ts

c = F.col
S = lambda v: f"severity='{v}'"


def r(df, digits, *cols):
    return df.withColumns({x: F.round(x, digits) for x in cols})


# --- vectors -------------------------------------------------------------------

@check("o306_reputation_features", f"""SELECT src_ip, count(*) AS total, {n(S('critical'))} AS crit, {n(S('high'))} AS high, {n(S('medium'))} AS med, {n(S('low'))} AS low, max(rule_level) AS max_level,
 count(DISTINCT dst_port) AS uniq_ports, count(DISTINCT dst_ip) AS uniq_dsts, count(DISTINCT country) AS uniq_countries, count(DISTINCT nullif(username,'')) AS uniq_users,
 {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen, any_value(top) AS top FROM plogs LEFT JOIN
 (SELECT src_ip, array_to_string(list(threat_type||':'||n ORDER BY n DESC, threat_type)[1:5],',') AS top FROM (SELECT src_ip, threat_type, count(*) AS n FROM plogs WHERE threat_type<>'' GROUP BY 1,2) GROUP BY 1) USING (src_ip) GROUP BY 1""")
def _(t):
    out = FE.reputation_features(t.plogs)
    text = F.array_join(F.transform("top_threats", lambda x: F.concat(x["threat_type"], F.lit(":"), x["events"].cast("string"))), ",")
    return out.withColumn("top", text).drop("top_threats")


_EF = f"""count(*) AS events, max(rule_level) AS max_lvl, avg(rule_level) AS avg_lvl, {n(S('critical'))} AS crit, {n(S('high'))} AS high, count(DISTINCT dst_ip) AS uniq_dst,
 count(DISTINCT nullif(dst_port,'')) AS uniq_ports, count(DISTINCT nullif(username,'')) AS uniq_users, count(DISTINCT country) AS uniq_countries, max(ts) AS last_seen"""
define("lead_threats", "SELECT src_ip AS entity, threat_type AS top_threat FROM logs GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, threat_type DESC)=1")
define("entity_vec", f"SELECT * FROM (SELECT src_ip AS entity, {_EF} FROM logs WHERE src_ip<>'' GROUP BY 1) JOIN lead_threats USING (entity)")


@check("o319_entity_features", f"SELECT entity, events, max_lvl, round(avg_lvl,6) AS avg_lvl, crit, high, uniq_dst, uniq_ports, uniq_users, uniq_countries, top_threat, {ts('last_seen')} AS last_seen FROM entity_vec")
def _(t):
    return r(FE.entity_features(t.logs), 6, "avg_lvl")


_CNT = ", ".join(f"{n('threat_type=' + repr(v))} AS {k}" for k, v in [("ssh_bf_cnt", "ssh_bruteforce"), ("rdp_cnt", "rdp_relay"), ("db_scan_cnt", "db_scan"), ("known_bad_cnt", "known_malicious"), ("priv_esc_cnt", "privilege_escalation"), ("vpn_bf_cnt", "vpn_bruteforce")])
define("win_feat", f"""SELECT src_ip AS ip, count(*)::DOUBLE AS n_events, count(*)/greatest(1.0::DOUBLE, date_diff('minute', min(ts), {NOW})::DOUBLE) AS event_rate_pm,
 date_diff('second', date_trunc('second',min(ts)), date_trunc('second',max(ts)))::DOUBLE/greatest(1, count(*)-1) AS avg_interval_s, 0.0::DOUBLE AS min_interval_s, 0.0::DOUBLE AS std_interval_s,
 count(DISTINCT nullif(dst_ip,'')) AS unique_dst_ips, count(DISTINCT nullif(dst_port,'')) AS unique_dst_ports, count(DISTINCT nullif(country,'')) AS unique_countries,
 {n(S('critical'))}/count(*)::DOUBLE AS pct_critical, {n(S('high'))}/count(*)::DOUBLE AS pct_high, {n("threat_type IN ('brute_force','ssh_bruteforce','vpn_bruteforce','rdp_relay')")} AS brute_force_cnt, {_CNT}
 FROM plogs WHERE ts >= {NOW} - INTERVAL 7 DAY GROUP BY 1 HAVING count(*)>=3""")
define("dev_counts", f"SELECT ip, count(*) AS baseline_alerts, {n(S('critical'))} AS critical_alerts FROM latest_dev GROUP BY 1")
_R6 = "event_rate_pm avg_interval_s pct_critical pct_high".split()


@check("o325_window_features", "SELECT * REPLACE (" + ", ".join(f"round({x},6) AS {x}" for x in _R6) + ", coalesce(baseline_alerts,0) AS baseline_alerts, coalesce(critical_alerts,0) AS critical_alerts) FROM win_feat LEFT JOIN dev_counts USING (ip)")
def _(t):
    return r(FE.window_features(t.plogs, K.alert_counts(dev(t)), as_of=AS_OF), 6, *_R6)


@check("o206_features_with_alerts", "SELECT ip, n_events, coalesce(baseline_alerts,0) AS baseline_alerts, coalesce(critical_alerts,0) AS critical_alerts FROM win_feat LEFT JOIN dev_counts USING (ip)")
def _(t):
    f = FE.window_features(t.plogs, as_of=AS_OF).drop("baseline_alerts", "critical_alerts")
    return FE.with_alert_counts(f, K.alert_counts(dev(t))).select("ip", "n_events", "baseline_alerts", "critical_alerts")


@check("o326_event_features", f"""SELECT src_ip AS ip, count(*) AS n_events, round_even(count(*)/((epoch_us(max(ts))-epoch_us(min(ts)))/1e6+1)*60,3) AS event_rate_pm, coalesce(round_even(avg(g),3),0) AS avg_interval_s,
 coalesce(round_even(min(g),3),0) AS min_interval_s, coalesce(round_even(stddev_pop(g),3),0) AS std_interval_s, count(DISTINCT nullif(dst_ip,'')) AS unique_dst_ips, count(DISTINCT nullif(dst_port,'')) AS unique_dst_ports,
 count(DISTINCT nullif(country,'')) AS unique_countries, round_even({n(S('critical'))}/count(*)::DOUBLE,3) AS pct_critical, round_even({n(S('high'))}/count(*)::DOUBLE,3) AS pct_high,
 {n("threat_type='brute_force'")} AS brute_force_cnt, {_CNT}, 0::BIGINT AS baseline_alerts, 0::BIGINT AS critical_alerts
 FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip ORDER BY ts, event_id))/1e6 AS g FROM plogs) GROUP BY 1""")
def _(t):
    return FE.event_features(t.plogs)


# --- baselines --------------------------------------------------------------------

_PTS = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
_NET = "CASE WHEN len(string_split({0},'.'))=4 THEN array_to_string(string_split({0},'.')[1:3],'.') END"
define("base_rows", f"SELECT * FROM plogs WHERE ts < {NOW} - INTERVAL 24 HOUR")
define("base_scalar", f"""SELECT src_ip AS ip, count(*) AS event_count, round_even(count(*)/count(DISTINCT CAST(ts AS DATE))::DOUBLE,2) AS avg_daily_events, round_even(avg({_PTS}),3) AS avg_severity_score,
 {n("threat_type='login_success'")} AS total_successes, {n("threat_type IN ('brute_force','ssh_bruteforce','vpn_bruteforce')")} AS total_failures FROM base_rows GROUP BY 1 HAVING count(*)>=10""")
_DIMS = {"ports": "nullif(dst_port,'')", "dst_ips": "nullif(dst_ip,'')", "subnets": _NET.format("dst_ip"), "countries": "nullif(country,'')", "hours": "CAST(hour(ts) AS VARCHAR)",
         "weekdays": "CAST(isodow(ts)-1 AS VARCHAR)", "threat_types": "threat_type", "days": "strftime(ts,'%Y-%m-%d')"}
define("base_values", " UNION ALL ".join(f"SELECT src_ip AS ip, '{d}' AS dimension, {e} AS value, count(*) AS events FROM base_rows WHERE {e} IS NOT NULL GROUP BY ALL" for d, e in _DIMS.items()))
define("base_lists", "SELECT src_ip AS ip, " + ", ".join(f"coalesce(list_distinct(list({e}) FILTER (WHERE {e} IS NOT NULL)),[]) AS {d}" for d, e in _DIMS.items()) + " FROM base_rows GROUP BY 1")


def base(t):
    return B.build_baselines(t.plogs, AS_OF)


@check("o329_baseline_scalars", "SELECT * FROM base_scalar")
def _(t):
    return base(t).addresses.select("ip", "event_count", "avg_daily_events", "avg_severity_score", "total_successes", "total_failures")


@check("o329_baseline_maps", "SELECT ip, dimension, value, events FROM base_values WHERE ip IN (SELECT ip FROM base_scalar)")
def _(t):
    b = base(t)
    return b.values.join(b.addresses, "ip", "left_semi")


define("judged", f"""SELECT e.*, b.*, bl.* EXCLUDE (ip) FROM (SELECT event_id, ts, src_ip, dst_ip, nullif(dst_port,'') AS port, nullif(dst_ip,'') AS dst, nullif(country,'') AS cty, threat_type, severity,
  {_NET.format("dst_ip")} AS net, {_PTS} AS pts, len(list_distinct(list_filter(list(nullif(dst_ip,'')) OVER w50, lambda x: x IS NOT NULL))) AS recent_dsts,
  count(g) OVER w20 AS gaps, avg(g) OVER w20 AS avg_gap, coalesce(stddev_samp(g) OVER w20, 0) AS std_gap, row_number() OVER (PARTITION BY src_ip, CAST(ts AS DATE) ORDER BY ts, event_id) AS today
  FROM (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY src_ip ORDER BY ts, event_id))/1e6 AS g FROM plogs)
  WINDOW w50 AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS 49 PRECEDING), w20 AS (PARTITION BY src_ip ORDER BY ts, event_id ROWS 18 PRECEDING)) e
 JOIN base_scalar b ON b.ip=e.src_ip JOIN base_lists bl ON bl.ip=e.src_ip WHERE e.ts >= {NOW} - INTERVAL 24 HOUR""")
_SENS = "port IN (" + ",".join(f"'{p}'" for p in X.SENSITIVE_PORTS) + ")"
_INT = lambda col: f"regexp_matches({col}, '^(10[.]|192[.]168[.]|172[.](1[6-9]|2[0-9]|3[01])[.])')"
_RULES = [
    ("port_shift", "port IS NOT NULL AND len(ports)>0 AND NOT list_contains(ports, port)", f"CASE WHEN {_SENS} THEN 'critical' ELSE 'high' END", "port"),
    ("sensitive_port_targeted", f"{_SENS} AND NOT list_contains(ports, port)", "'critical'", "port"),
    ("new_subnet_reached", "net IS NOT NULL AND len(subnets)>0 AND NOT list_contains(subnets, net)", "'high'", "net"),
    ("internal_host_reached", f"dst IS NOT NULL AND {_INT('dst')} AND NOT {_INT('src_ip')}", "'critical'", "dst"),
    ("target_shift", "len(dst_ips)>0 AND recent_dsts>len(dst_ips)*2 AND recent_dsts>5", "'critical'", "CAST(recent_dsts AS VARCHAR)"),
    ("country_shift", "cty IS NOT NULL AND len(countries)>=2 AND NOT list_contains(countries, cty)", "'medium'", "cty"),
    ("off_hours_activity", "len(hours)>=5 AND NOT list_contains(hours, CAST(hour(ts) AS VARCHAR))", "'high'", "CAST(hour(ts) AS VARCHAR)"),
    ("weekend_anomaly", "len(weekdays)>0 AND isodow(ts)>=6 AND NOT list_contains(weekdays,'5') AND NOT list_contains(weekdays,'6')", "'high'", "CAST(isodow(ts)-1 AS VARCHAR)"),
    ("volume_spike", "avg_daily_events>5 AND today>avg_daily_events*3", "'critical'", "CAST(today AS VARCHAR)"),
    ("new_rule_category", "len(threat_types)>0 AND NOT list_contains(threat_types, threat_type) AND threat_type<>'unknown'", "CASE WHEN threat_type IN ('privilege_escalation','rdp_relay','known_malicious') THEN 'critical' ELSE 'high' END", "threat_type"),
    ("rule_escalation", "avg_severity_score>0 AND pts>avg_severity_score+1.5", "'high'", "severity"),
    ("first_success_after_failures", "threat_type='login_success' AND total_failures>=5 AND total_successes=0", "'critical'", "CAST(total_failures AS VARCHAR)"),
    ("automated_tool_detected", "gaps>=9 AND avg_gap<0.5 AND std_gap<0.1", "'high'", "''"),
    ("dormant_ip_reactivated", "date_diff('day', CAST(list_max(days) AS DATE), CAST(ts AS DATE))>=7", "'high'", "CAST(date_diff('day', CAST(list_max(days) AS DATE), CAST(ts AS DATE)) AS VARCHAR)"),
]
define("dev_found", " UNION ALL ".join(f"SELECT src_ip AS ip, event_id, ts, '{k}' AS type, {sev} AS severity, {d} AS detail FROM judged WHERE {w}" for k, w, sev, d in _RULES))


@check("o601_deviations", f"SELECT ip, event_id, {ts('ts')} AS ts, type, severity, detail FROM dev_found")
def _(t):
    out = B.deviations(t.plogs, t.baselines, AS_OF)
    return out.withColumn("detail", F.when(c("type") == "automated_tool_detected", "").otherwise(c("detail")))


@check("o602_deviation_scan", f"SELECT ip, type, severity, {ts('ts')} AS ts FROM dev_found QUALIFY row_number() OVER (PARTITION BY ip, type ORDER BY dev_found.ts DESC, event_id DESC)=1")
def _(t):
    return B.deviation_scan(t.plogs, t.baselines, AS_OF).select("ip", "type", "severity", "ts")


@check("o209_events_with_baseline", "SELECT event_id, list_contains(ports, port) AS port_known FROM judged WHERE port IS NOT NULL")
def _(t):
    from wardlight.functions.times import ago, moment, since
    scan = since(t.plogs, ago(moment(AS_OF), hours=24))
    return B.events_with_known(scan, t.baselines, "ports").select("event_id", c("known").alias("port_known"))


@check("o411_recent_destinations", "SELECT event_id, recent_dsts FROM judged")
def _(t):
    return B.judged(t.plogs, t.baselines.addresses, AS_OF).select("event_id", "recent_dsts")


@check("o412_recent_gaps", "SELECT event_id, gaps AS recent_gaps, round(avg_gap,1) AS avg_gap, round(std_gap,1) AS std_gap FROM judged")
def _(t):
    return r(B.judged(t.plogs, t.baselines.addresses, AS_OF).select("event_id", "recent_gaps", "avg_gap", "std_gap"), 1, "avg_gap", "std_gap")


@check("o413_daily_position", "SELECT event_id, today FROM judged")
def _(t):
    return B.judged(t.plogs, t.baselines.addresses, AS_OF).select("event_id", "today")


@check("o505_rebuild_due", f"SELECT src_ip, n AS events FROM (SELECT src_ip, count(*) AS n, {n(f'ts < {NOW} - INTERVAL 5 DAY')} AS m FROM logs GROUP BY 1) WHERE n//20 > m//20")
def _(t):
    from wardlight.functions.times import ago, moment, until
    old = K.event_counts(until(t.logs, ago(moment(AS_OF), days=5)))
    return B.rebuild_due(old, K.event_counts(t.logs), 20)


# --- takeover -----------------------------------------------------------------------

_LOGIN = "threat_type IN ('login_success','brute_force','ssh_bruteforce','vpn_bruteforce','rdp_relay') AND username<>''"
define("logins", f"SELECT *, threat_type<>'login_success' AND src_ip<>'' AS failed FROM plogs WHERE {_LOGIN}")
define("wins", """SELECT username, src_ip, ts, event_id, trim(country) AS country, failures FROM (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY username, src_ip ORDER BY ts
 RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW)::BIGINT AS failures FROM logins) WHERE threat_type='login_success'""")
define("firsts", "SELECT username, country, ts, event_id, row_number() OVER (PARTITION BY username ORDER BY ts, event_id) AS position FROM (SELECT * FROM wins WHERE country<>'' QUALIFY row_number() OVER (PARTITION BY username, country ORDER BY ts, event_id)=1)")
define("ato_rows", """SELECT *, CASE WHEN failures>=5 AND new_country THEN 'critical' ELSE 'high' END AS severity FROM (SELECT w.*, f.position IS NOT NULL AS new_country FROM wins w LEFT JOIN (SELECT * FROM firsts WHERE position>1) f
 ON f.username=w.username AND f.event_id=w.event_id) WHERE failures>=5 OR new_country""")


def ato(t):
    return TO.account_takeovers(login_events(t.plogs))


@check("o407_failures_before", "SELECT username, event_id, failures FROM wins")
def _(t):
    return TO.failures_before(login_events(t.plogs)).select("username", "event_id", "failures")


@check("o210_failures_in_window", "SELECT src_ip, sum(failures)::BIGINT AS failures, count(*) AS successes FROM wins GROUP BY 1")
def _(t):
    return TO.failures_before(login_events(t.plogs)).groupBy("src_ip").agg(F.sum("failures").alias("failures"), F.count(F.lit(1)).alias("successes"))


@check("o408_first_countries", f"SELECT username, country, {ts('ts')} AS ts, position FROM firsts")
def _(t):
    return TO.first_countries(login_events(t.plogs)).select("username", "country", c("at.ts").alias("ts"), "position")


@check("o603_account_takeovers", f"""SELECT a.username, a.src_ip, {ts('a.ts')} AS ts, a.country, a.failures, a.new_country, a.severity,
 coalesce((SELECT string_agg(f.country, ',' ORDER BY f.country) FROM firsts f WHERE f.username=a.username AND (f.ts < a.ts OR (f.ts=a.ts AND f.event_id<a.event_id))),'') AS usual FROM ato_rows a""")
def _(t):
    return ato(t).select("username", "src_ip", "ts", "country", "failures", "new_country", "severity", F.array_join("usual_countries", ",").alias("usual"))


# --- travel -----------------------------------------------------------------------------

define("placed", f"""SELECT username, src_ip, ts, event_id, trim(country) AS country, CASE WHEN abs(geo_lat)>0.01 OR abs(geo_lon)>0.01 THEN geo_lat ELSE clat END AS lat,
 CASE WHEN abs(geo_lat)>0.01 OR abs(geo_lon)>0.01 THEN geo_lon ELSE clon END AS lon FROM logins LEFT JOIN {CENTROIDS} ON cname=trim(country)
 WHERE abs(geo_lat)>0.01 OR abs(geo_lon)>0.01 OR clat IS NOT NULL""")
# cluster starts, one after the other per user
define("linked", "SELECT *, min(ts) OVER (PARTITION BY username ORDER BY ts RANGE BETWEEN INTERVAL '5.000001 seconds' FOLLOWING AND INTERVAL 400 DAY FOLLOWING) AS nxt FROM placed")
_REC = """WITH RECURSIVE anchors AS (SELECT username, min(ts) AS anchor FROM placed GROUP BY 1 UNION
  SELECT l.username, l.nxt FROM anchors a JOIN (SELECT DISTINCT username, ts, nxt FROM linked) l ON l.username=a.username AND l.ts=a.anchor WHERE l.nxt IS NOT NULL),
 grouped AS (SELECT p.*, anchor FROM placed p ASOF JOIN anchors a ON a.username=p.username AND p.ts>=a.anchor),
 heads AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY username, anchor, country ORDER BY ts, event_id)=1),
 pairs AS (SELECT x.username, x.anchor, x.country AS a, y.country AS b, x.src_ip AS ip1, y.src_ip AS ip2, x.ts, """ + _HAV("x.lat", "x.lon", "y.lat", "y.lon") + """ AS km FROM heads x JOIN heads y
  ON x.username=y.username AND x.anchor=y.anchor AND (x.ts<y.ts OR (x.ts=y.ts AND x.event_id<y.event_id)) AND x.country<>y.country),
 at_once AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY username, anchor ORDER BY km DESC)=1 AND km>=400),
 rest AS (SELECT * FROM grouped WHERE (username, anchor) NOT IN (SELECT (username, anchor) FROM at_once)),
 moved AS (SELECT * FROM (SELECT *, lag(country) OVER (PARTITION BY username ORDER BY ts, event_id) AS pc FROM rest) WHERE pc IS NULL OR pc<>country),
 hops AS (SELECT username, ts, event_id, pcty AS a, country AS b, pip AS ip1, src_ip AS ip2, (epoch_us(ts)-epoch_us(pts))/1e6/3600.0 AS hours, """ + _HAV("plat", "plon", "lat", "lon") + """ AS km FROM
  (SELECT *, lag(country) OVER w AS pcty, lag(src_ip) OVER w AS pip, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, lag(ts) OVER w AS pts FROM moved WINDOW w AS (PARTITION BY username ORDER BY ts, event_id)) WHERE pcty IS NOT NULL),
 best AS (SELECT * FROM hops WHERE km>=400 AND hours>1.0/3600 AND km/hours>900 QUALIFY row_number() OVER (PARTITION BY username, least(a,b), greatest(a,b) ORDER BY round_even(km,1) DESC, ts, event_id)=1),
 found AS (SELECT username, ts, 'critical' AS severity, a, b, ip1, ip2, round_even(km,1) AS km FROM at_once UNION ALL SELECT username, ts, 'high', a, b, ip1, ip2, round_even(km,1) FROM best),
 trav AS (SELECT * FROM found) """


def travel(t):
    return TR.impossible_travel(login_events(t.plogs))


@check("o604_impossible_travel", _REC + f"SELECT username, {ts('ts')} AS ts, severity, a AS origin, b AS target, km AS distance_km FROM trav")
def _(t):
    return travel(t).select("username", "ts", "severity", c("origin.country").alias("origin"), c("target.country").alias("target"), "distance_km")


@check("o409_simultaneous", _REC + f"SELECT username, {ts('ts')} AS ts, a AS origin, b AS target, round_even(km,1) AS distance_km FROM at_once")
def _(t):
    found = TR.simultaneous(TR.clusters(TR.placed_events(login_events(t.plogs))))
    return found.select("username", "ts", c("origin.country").alias("origin"), c("target.country").alias("target"), "distance_km")


@check("o410_sequential", _REC.replace("NOT IN (SELECT (username, anchor) FROM at_once)", "IS NOT NULL") + f"SELECT username, {ts('ts')} AS ts, a AS origin, b AS target, round_even(km,1) AS distance_km, round_even(hours,4) AS hours FROM best")
def _(t):
    found = TR.sequential(TR.placed_events(login_events(t.plogs)))
    return found.select("username", "ts", c("origin.country").alias("origin"), c("target.country").alias("target"), "distance_km", "hours")


# --- users -----------------------------------------------------------------------------------

_ND = f"ts >= {NOW} - INTERVAL 1 DAY"
define("people", f"SELECT * FROM plogs WHERE ts >= {NOW} - INTERVAL 30 DAY AND username<>'' AND NOT ends_with(username,'$') AND lower(username)<>lower(agent)")
define("user_scalar", f"""SELECT username, {n('NOT ' + _ND)} AS ev_base, {n(_ND)} AS ev_24, {n("threat_type IN ('brute_force','ssh_bruteforce','vpn_bruteforce','rdp_relay') AND " + _ND)} AS fails_24,
 {n("threat_type='login_success' AND " + _ND)} AS success_24, {n("severity IN ('high','critical') AND " + _ND)} AS crit_24, max(ts) AS last_ts FROM people GROUP BY 1 HAVING count(*)>=5""")
_UD = {"hosts": "nullif(agent,'')", "countries": "nullif(country,'')", "ports": "nullif(dst_port,'')", "srcs": "nullif(src_ip,'')", "hours": "CAST(hour(ts) AS VARCHAR)", "dates": "strftime(ts,'%Y-%m-%d')"}
define("user_values", " UNION ALL ".join(f"SELECT username, '{d}' AS dimension, {e} AS value, {n('NOT ' + _ND)} AS base, {n(_ND)} AS day FROM people WHERE {e} IS NOT NULL GROUP BY ALL" for d, e in _UD.items()))


@check("o321_user_profiles", f"""SELECT s.username, ev_base, ev_24, fails_24, success_24, crit_24, {ts('last_ts')} AS last_ts,
 {n("dimension='hosts' AND base>0")} AS hosts_base_n, {n("dimension='ports' AND day>0")} AS ports_24_n, {n("dimension='countries' AND day>0 AND base=0")} AS countries_new_n,
 array_to_string(list(value ORDER BY value) FILTER (WHERE dimension='ports' AND base>0), ',') AS ports,
 coalesce(sum(base) FILTER (WHERE dimension='hours' AND value='13'),0)::BIGINT AS at_13,
 coalesce(sum(base+day) FILTER (WHERE dimension='dates' AND value='2024-01-28'),0)::BIGINT AS on_28 FROM user_scalar s JOIN user_values v USING (username) GROUP BY ALL""")
def _(t):
    zero = lambda m, k: F.coalesce(c(m)[k], F.lit(0))
    return U.user_profiles(t.plogs, as_of=AS_OF).select(
        "username", "ev_base", "ev_24", "fails_24", "success_24", "crit_24", "last_ts", "hosts_base_n", "ports_24_n", "countries_new_n",
        F.array_join("ports_base", ",").alias("ports"), zero("hours_base", "13").alias("at_13"), zero("days_7", "2024-01-28").alias("on_28"))


@check("o321_user_values", "SELECT * FROM user_values")
def _(t):
    from wardlight.functions.times import ago, moment, since
    return U.user_values(U.people(since(t.plogs, ago(moment(AS_OF), days=30))), ago(moment(AS_OF), days=1))


@check("o462_new_values", "SELECT username, dimension, string_agg(value, ',' ORDER BY value) AS fresh FROM user_values WHERE dimension IN ('hosts','countries','ports') AND day>0 AND base=0 GROUP BY 1,2")
def _(t):
    from wardlight.functions.times import ago, moment, since
    values = U.user_values(U.people(since(t.plogs, ago(moment(AS_OF), days=30))), ago(moment(AS_OF), days=1))
    fresh = U.new_values(values).where("dimension in ('hosts', 'countries', 'ports')")
    return fresh.groupBy("username", "dimension").agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("fresh"))


@check("o463_user_names", "SELECT username, array_to_string(list(value ORDER BY value) FILTER (WHERE dimension='hosts')[1:6],',') AS hosts, array_to_string(list(value ORDER BY value) FILTER (WHERE dimension='countries')[1:6],',') AS countries FROM user_values WHERE dimension IN ('hosts','countries') GROUP BY 1")
def _(t):
    out = U.user_names(t.plogs, as_of=AS_OF)
    text = lambda x: F.nullif(F.array_join(x, ","), F.lit("")).alias(x)
    return out.select("username", text("hosts"), text("countries"))


def _peers(rows):
    feats = X.PEER_FEATURES
    stat = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in feats)
    z = lambda f: f"(CASE WHEN s_{f}>1e-9 THEN ({f}-m_{f})/s_{f} END)"
    top = "greatest(0, " + ", ".join(f"coalesce({z(f)},0)" for f in feats) + ")"
    names = "||".join(f"(CASE WHEN {z(f)}>=2.5 THEN '{f};' ELSE '' END)" for f in feats)
    return f"SELECT entity, round_even({top},2) AS max_z, CASE WHEN {top}>=4.0 THEN 'high' ELSE 'medium' END AS severity, {names} AS features FROM ({rows}), (SELECT count(*) AS n, {stat} FROM ({rows})) WHERE n>=5 AND {top}>=2.5"


def _peer_view(df):
    names = F.transform("drivers", lambda d: d["feature"])
    return df.select("entity", "max_z", "severity", F.concat(*[F.when(F.array_contains(names, f), f + ";").otherwise("") for f in X.PEER_FEATURES]).alias("features"))


@check("o414_peer_outliers", _peers(ENTITY_AGG("username")))
def _(t):
    return _peer_view(U.peer_outliers(K.entity_aggregates(t.logs)))


@check("o606_host_outliers", _peers(ENTITY_AGG("agent")))
def _(t):
    return _peer_view(U.entity_outliers(t.logs, "agent"))


@check("o216_outliers_with_rows", f"WITH e AS ({ENTITY_AGG('username')}), p AS ({_peers(ENTITY_AGG('username'))}) SELECT e.entity, e.events, p.max_z FROM e LEFT JOIN p USING (entity)")
def _(t):
    rows = K.entity_aggregates(t.logs)
    return rows.join(U.peer_outliers(rows).select("entity", "max_z"), "entity", "left").select("entity", "events", "max_z")


_PR = """SELECT username AS entity, ev_24 AS events, crit_24 AS crit, p AS dsts, p AS ports, ct AS countries, sr AS srcs FROM user_scalar JOIN (SELECT username,
 count(*) FILTER (WHERE dimension='ports' AND day>0) AS p, count(*) FILTER (WHERE dimension='countries' AND day>0) AS ct, count(*) FILTER (WHERE dimension='srcs' AND day>0) AS sr FROM user_values GROUP BY 1) USING (username)"""
_RISK = _REC + f""", hist AS (SELECT *, base>0 AND base/greatest(sum(base) OVER (PARTITION BY username),1)::DOUBLE>=0.02 AS usual FROM user_values WHERE dimension='hours'),
 off AS (SELECT username, bool_or(NOT usual AND day>=3) AND bool_or(usual) AS odd FROM hist GROUP BY 1),
 cnt AS (SELECT username, count(*) FILTER (WHERE dimension='hosts' AND base>0) AS hb, count(*) FILTER (WHERE dimension='hosts' AND day>0 AND base=0) AS hn, count(*) FILTER (WHERE dimension='countries' AND base>0) AS cb,
  count(*) FILTER (WHERE dimension='countries' AND day>0 AND base=0) AS cn FROM user_values GROUP BY 1), peer AS ({_peers(_PR)}),
 pts AS (SELECT s.username, ev_24, ev_base, CASE WHEN ev_base>=50 AND hb>0 THEN least(hn,2)*22 ELSE 0 END AS p1, CASE WHEN ev_base>=50 AND cb>0 THEN least(cn,2)*28 ELSE 0 END AS p2, CASE WHEN ev_base>=50 AND odd THEN 18 ELSE 0 END AS p3,
  CASE WHEN ev_base>=50 AND ev_base/29.0>=2 AND ev_24>=30 AND ev_24/(ev_base/29.0)>=5 THEN 15 ELSE 0 END AS p4, CASE WHEN fails_24>=20 AND success_24>=1 THEN 30 WHEN fails_24>=20 THEN 15 ELSE 0 END AS p5,
  least(20, crit_24*4) AS p6, CASE WHEN s.username IN (SELECT username FROM trav) THEN 35 ELSE 0 END AS p7, CASE WHEN s.username IN (SELECT entity FROM peer) THEN 12 ELSE 0 END AS p8
  FROM user_scalar s JOIN cnt USING (username) JOIN off USING (username)), scored AS (SELECT *, least(100, p1+p2+p3+p4+p5+p6+p7+p8)::BIGINT AS score FROM pts) """


@check("o605_user_risk", _RISK + "SELECT username, score, CASE WHEN score>=70 THEN 'critical' WHEN score>=45 THEN 'high' WHEN score>=25 THEN 'medium' ELSE 'low' END AS level, ev_24, ev_base, (p1>0)::INT+(p2>0)::INT+(p3>0)::INT+(p4>0)::INT+(p5>0)::INT+(p6>0)::INT+(p7>0)::INT+(p8>0)::INT AS drivers FROM scored WHERE score>0")
def _(t):
    return U.user_risk(t.plogs, travel(t), as_of=AS_OF).select("username", "score", "level", "ev_24", "ev_base", F.size("drivers").alias("drivers"))


@check("o215_travel_with_profiles", _REC + "SELECT s.username, ev_24, coalesce(n,0) AS travels FROM user_scalar s LEFT JOIN (SELECT username, count(*) AS n FROM trav GROUP BY 1) USING (username)")
def _(t):
    users = U.user_profiles(t.plogs, as_of=AS_OF).select("username", "ev_24")
    hops = travel(t).groupBy("username").agg(F.count(F.lit(1)).alias("travels"))
    return users.join(hops, "username", "left").fillna(0, ["travels"])


@check("o211_findings_by_ip", _REC + "SELECT ip, kind, count(*) AS findings FROM (SELECT src_ip AS ip, 'account_takeover' AS kind FROM ato_rows UNION ALL SELECT unnest([ip1, ip2]), 'impossible_travel' FROM trav) WHERE ip<>'' GROUP BY 1,2")
def _(t):
    from wardlight.operators.incidents import findings_by_ip
    return findings_by_ip(ato(t), travel(t)).groupBy("ip", "kind").agg(F.count(F.lit(1)).alias("findings"))


_PROF = {"country": "country", "host": "agent", "src_ip": "src_ip", "rule": "rule", "rule_id": "rule_id", "dst_port": "dst_port"}
_PV = " UNION ALL ".join(f"SELECT username AS entity, '{d}' AS dimension, {e} AS value, count(*) AS events FROM logs WHERE username<>'' AND {e}<>'' GROUP BY ALL" for d, e in _PROF.items())
_PA = " UNION ALL ".join(f"SELECT username AS entity, '{d}' AS dimension, {d} AS value, count(*) AS events FROM logs WHERE username<>'' AND {d}<>'' GROUP BY ALL" for d in ("threat_type", "severity"))
define("prof_values", f"SELECT * FROM (SELECT * FROM ({_PV}) QUALIFY row_number() OVER (PARTITION BY entity, dimension ORDER BY events DESC, value)<=10) UNION ALL {_PA}")


@check("o330_entity_values", "SELECT * FROM prof_values")
def _(t):
    return U.entity_values(t.logs, "username")


@check("o330_entity_profiles", f"""SELECT username AS entity, count(*) AS total_events, {n("action='allowed'")} AS allowed, {n("action IN ('blocked','denied')")} AS blocked, {ts('min(ts)')} AS first_seen, {ts('max(ts)')} AS last_seen,
 'host '||any_value(h)||coalesce(' ('||any_value(cc)||')','') AS origin FROM logs LEFT JOIN (SELECT entity, first(value ORDER BY events DESC, value) FILTER (WHERE dimension='host') AS h, first(value ORDER BY events DESC, value) FILTER (WHERE dimension='country') AS cc FROM prof_values GROUP BY 1) ON entity=username WHERE username<>'' GROUP BY 1""")
def _(t):
    return U.entity_profiles(t.logs).select("entity", "total_events", "allowed", "blocked", "first_seen", "last_seen", "origin")
