"""Telemetry, risk, indicators, kill chain, incidents, playbooks (2.3, 2.8)."""

from pyspark.sql import functions as F

from wardlight.functions import columns as C, fixed as X
from wardlight.operators import counts as K, features as FE, incidents as I, intel as N, killchain as KC, risk as RK, rollups as R, telemetry as TE, users as U

from .behaviour_checks import S, _REC, ato, base, r, travel
from .count_checks import R_, blocks, dev, disp, scores
from .function_checks import IDS_SQL, TACTIC_RANK, _NAME, _TACTIC, _map_sql
from .registry import AS_OF, NOW, check, define, n, ts

c = F.col

# --- telemetry -------------------------------------------------------------------

define("agent_hours", f"SELECT agent, hour, hour - lag(hour) OVER (PARTITION BY agent ORDER BY hour) AS gap FROM (SELECT DISTINCT agent, epoch(date_trunc('hour',ts))::BIGINT AS hour FROM plogs WHERE agent<>'' AND ts >= {NOW} - INTERVAL 14 DAY)")
define("agent_gaps", "SELECT agent, coalesce(avg(gap),3600)::DOUBLE AS avg_gap, coalesce(max(gap),3600)::BIGINT AS max_gap, count(*) AS active_hours FROM agent_hours GROUP BY 1")
define("agent_act", f"SELECT agent, count(*) AS total, min(ts) AS first_ts, max(ts) AS last_ts, {n(f'ts >= {NOW} - INTERVAL 1 DAY')} AS last24 FROM plogs WHERE agent<>'' AND ts >= {NOW} - INTERVAL 14 DAY GROUP BY 1 HAVING count(*)>=10")
_SPAN = lambda s: f"(CASE WHEN {s}<60 THEN {s}||'s' WHEN {s}<3600 THEN ({s}//60)||'m' WHEN {s}<86400 THEN ({s}//3600)||'h '||({s}%3600//60)||'m' ELSE ({s}//86400)||'d '||({s}%86400//3600)||'h' END)"
_US = lambda a, b: f"(epoch_us({b})-epoch_us({a}))/1e6"
define("silence", f"""SELECT agent, CASE WHEN quiet>expected*2 THEN 'silent_critical' WHEN quiet>expected THEN 'silent' WHEN drop_pct>=75 THEN 'degraded' ELSE 'ok' END AS status, last_ts, quiet, expected, total, last24, avg_day, drop_pct
 FROM (SELECT *, CASE WHEN avg_day>=5 THEN round_even(greatest(0.0::DOUBLE, 1-last24/avg_day)*100,0)::BIGINT ELSE 0 END AS drop_pct FROM (SELECT *, greatest(avg_gap*3, max_gap*1.5::DOUBLE, 3600) AS expected, {_US('last_ts', NOW)} AS quiet,
 total/greatest(1.0::DOUBLE, {_US('first_ts', NOW)}/86400) AS avg_day FROM agent_act JOIN agent_gaps USING (agent)))""")


@check("o338_agent_activity", f"SELECT agent, total, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, last24 FROM agent_act")
def _(t):
    return TE.agent_activity(t.plogs, as_of=AS_OF)


@check("o405_hour_gaps", "SELECT agent, round(avg_gap,4) AS avg_gap, max_gap, active_hours FROM agent_gaps")
def _(t):
    return r(TE.hour_gaps(t.plogs, as_of=AS_OF), 4, "avg_gap")


@check("o607_silence_report", f"SELECT agent, status, {ts('last_ts')} AS last_seen, CAST(floor(quiet) AS BIGINT) AS quiet_seconds, {_SPAN('CAST(floor(quiet) AS BIGINT)')} AS quiet_for, {_SPAN('CAST(floor(expected) AS BIGINT)')} AS expected_max_gap, total AS events_total, last24 AS events_24h, round_even(avg_day,1) AS avg_per_day, drop_pct FROM silence")
def _(t):
    return TE.silence_report(t.plogs, as_of=AS_OF)


@check("o607_silence_summary", f"SELECT count(*) AS total, {n('status LIKE ' + repr('silent%'))} AS silent, {n('status=' + repr('degraded'))} AS degraded, {n('status=' + repr('ok'))} AS ok FROM silence")
def _(t):
    return TE.silence_summary(TE.silence_report(t.plogs, as_of=AS_OF))


@check("o608_novelties", f"SELECT kind, key, split_part(key,'|',1) AS subject, CASE WHEN kind='user_host' THEN split_part(key,'|',2) ELSE '' END AS agent, {ts('first_ts')} AS first_ts, events FROM ledger WHERE kind<>'binary_host' AND ledger.first_ts >= {NOW} - INTERVAL 7 DAY")
def _(t):
    return TE.novelties(R.first_seen(t.plogs), 7, AS_OF)


define("rare_bins", "SELECT split_part(key,'|',1) AS proc_image, count(*) AS on_agents, sum(events)::BIGINT AS runs, min(first_ts) AS first_ts FROM ledger WHERE kind='binary_host' GROUP BY 1 HAVING count(*)<=2")


@check("o608_first_seen_summary", f"SELECT {ts('min(first_ts)')} AS history_from, {_US('min(first_ts)', NOW)}/86400 < 14 AS learning_mode, {n(f'kind<>' + repr('binary_host') + f' AND first_ts >= {NOW} - INTERVAL 7 DAY')} AS novelties, (SELECT count(*) FROM rare_bins) AS rare_binaries FROM ledger")
def _(t):
    return TE.first_seen_summary(R.first_seen(t.plogs), 7, AS_OF)


@check("o609_rare_binaries", f"SELECT proc_image, on_agents, runs, {ts('first_ts')} AS first_ts FROM rare_bins")
def _(t):
    return TE.rare_binaries(R.first_seen(t.plogs))


define("flow_rows", f"SELECT *, epoch(date_trunc('second',ts))::BIGINT - lag(epoch(date_trunc('second',ts))::BIGINT) OVER (PARTITION BY src_ip, dst_ip, dst_port ORDER BY ts, event_id) AS gap FROM plogs WHERE ts >= {NOW} - INTERVAL 24 HOUR AND src_ip<>'' AND dst_ip<>''")
define("flow_stats", f"""SELECT src_ip, dst_ip, dst_port, count(*) AS hits, {n("action='allowed'")} AS allowed_hits, {n("action IN ('blocked','denied')")} AS blocked_hits, min(ts) AS first_ts, max(ts) AS last_ts,
 round(avg(gap),1) AS period_s, round(CASE WHEN avg(gap)>0 THEN stddev_pop(gap)/avg(gap) ELSE 999 END,3) AS cv, coalesce(min(nullif(country,'')),'') AS country, coalesce(min(nullif(agent,'')),'') AS agent FROM flow_rows GROUP BY 1,2,3 HAVING count(*)>=12""")
_INFRA = "dst_port IN ('53','123','514','1514','1515','5601')"
define("beacons", f"SELECT *, round_even(greatest(0.0::DOUBLE, 1-cv/0.35::DOUBLE)*70 + least(30.0::DOUBLE, hits/4),0)::BIGINT AS score, {_INFRA} AS likely_infra, CASE WHEN {_INFRA} THEN 'infrastructure' WHEN allowed_hits>=blocked_hits THEN 'beacon_allowed' ELSE 'beacon_blocked' END AS verdict FROM flow_stats WHERE period_s BETWEEN 5 AND 3600 AND cv<0.35")


@check("o202_busy_flow_rows", "SELECT event_id FROM flow_rows WHERE (src_ip, dst_ip, dst_port) IN (SELECT (src_ip, dst_ip, dst_port) FROM flow_stats)")
def _(t):
    return TE.busy_flows(t.plogs, as_of=AS_OF).select("event_id")


@check("o406_flow_timing", "SELECT src_ip, dst_ip, dst_port, period_s, cv FROM flow_stats")
def _(t):
    return TE.flow_timing(TE.busy_flows(t.plogs, as_of=AS_OF))


@check("o610_beacons", f"SELECT src_ip, dst_ip, dst_port, hits, allowed_hits, blocked_hits, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts, period_s, cv, country, agent, score, likely_infra, verdict FROM beacons")
def _(t):
    return TE.beacon_report(t.plogs, as_of=AS_OF).drop("period")


define("policies", f"""SELECT pid AS policy, count(*) AS hits, {n("action='allowed'")} AS allowed, {n("action IN ('blocked','denied')")} AS blocked, {n(f'ts >= {NOW} - INTERVAL 1 DAY')} AS hits_24h, count(DISTINCT src_ip) AS src_count, count(DISTINCT dst_ip) AS dst_count,
 coalesce(list_sort(list(DISTINCT country) FILTER (WHERE country<>'' AND ts >= {NOW} - INTERVAL 1 DAY)),[]) AS c24, coalesce(list_sort(list(DISTINCT country) FILTER (WHERE country<>'' AND ts < {NOW} - INTERVAL 1 DAY)),[]) AS cb, min(ts) AS first_ts, max(ts) AS last_ts
 FROM (SELECT *, coalesce(nullif(policy_id,''), CASE WHEN raw<>'' THEN nullif(json_extract_string(nullif(raw,''),'$.data.policyid'),'') END, regexp_extract(full_log,'policyid="?([0-9]+)',1)) AS pid FROM plogs
 WHERE (decoder ILIKE '%fortigate%' OR decoder ILIKE '%firewall%' OR rule_groups ILIKE '%firewall%' OR rule ILIKE '%fortigate%' OR location ILIKE '%fortigate%') AND ts >= {NOW} - INTERVAL 7 DAY) WHERE pid<>'' GROUP BY 1""")
define("policy_view", "SELECT *, CASE WHEN sg>=3 THEN sg ELSE 0.0 END AS surge_x, list_sort(list_filter(c24, lambda x: NOT list_contains(cb, x))) AS fresh, pa>=20 AND hits_24h=0 AS went_quiet FROM (SELECT *, (hits-hits_24h)/6.0::DOUBLE AS pa, CASE WHEN (hits-hits_24h)/6.0::DOUBLE>=5 THEN round_even(hits_24h/((hits-hits_24h)/6.0::DOUBLE),1) ELSE 0.0::DOUBLE END AS sg FROM policies)")


@check("o335_policy_aggregates", f"SELECT policy, hits, allowed, blocked, hits_24h, src_count, dst_count, array_to_string(c24,',') AS c24, array_to_string(cb,',') AS cb, {ts('first_ts')} AS first_ts, {ts('last_ts')} AS last_ts FROM policies")
def _(t):
    return TE.policy_aggregates(t.plogs, as_of=AS_OF).withColumns({"c24": F.array_join("countries_24h", ","), "cb": F.array_join("countries_before", ",")}).drop("countries_24h", "countries_before")


@check("o611_policy_report", "SELECT policy, hits, hits_24h, surge_x, array_to_string(fresh,',') AS fresh, went_quiet FROM policy_view")
def _(t):
    return TE.policy_report(t.plogs, as_of=AS_OF).select("policy", "hits", "hits_24h", "surge_x", F.array_join("new_countries_24h", ",").alias("fresh"), "went_quiet")


define("policy_hits", "SELECT policy, 'surge' AS kind FROM policy_view WHERE surge_x>=3 UNION ALL SELECT policy, 'new_country' FROM policy_view WHERE len(fresh)>0 UNION ALL SELECT policy, 'went_quiet' FROM policy_view WHERE went_quiet")


@check("o611_policy_findings", "SELECT * FROM policy_hits")
def _(t):
    return TE.policy_findings(TE.policy_report(t.plogs, as_of=AS_OF)).select("policy", "kind")


define("cover", f"""SELECT agent, count(*) AS total, {n("proc_image<>'' OR proc_cmdline<>''")} AS process, {n("logon_type<>'' OR rule_groups ILIKE '%authentication%' OR rule ILIKE '%logon%' OR rule ILIKE '%login%'")} AS auth,
 {n("rule_groups ILIKE '%syscheck%' OR sc_path<>''")} AS fim, {n("mitre<>''")} AS mitre, max(ts) AS last_seen FROM plogs WHERE agent<>'' GROUP BY 1""")


@check("o336_agent_coverage", f"SELECT * REPLACE ({ts('last_seen')} AS last_seen) FROM cover")
def _(t):
    return TE.agent_coverage(t.plogs)


@check("o612_coverage_report", "SELECT agent, rtrim(CASE WHEN process=0 THEN 'process,' ELSE '' END||CASE WHEN auth=0 THEN 'auth,' ELSE '' END||CASE WHEN fim=0 THEN 'fim,' ELSE '' END, ',') AS gaps FROM cover")
def _(t):
    return TE.coverage_report(t.plogs).select("agent", F.array_join("gaps", ",").alias("gaps"))


@check("o612_coverage_summary", f"SELECT count(*) AS agents, {n('process=0 OR auth=0 OR fim=0')} AS with_gaps, {n('process>0 AND auth>0 AND fim>0')} AS fully_covered FROM cover")
def _(t):
    return TE.coverage_summary(TE.coverage_report(t.plogs))


@check("o337_tactic_volumes", "SELECT trim(x) AS tactic, count(*) AS events FROM (SELECT unnest(string_split(mitre_tactic || CASE WHEN event_id%3=0 THEN ', Impact' ELSE '' END, ',')) AS x FROM logs WHERE mitre_tactic<>'') GROUP BY 1")
def _(t):
    rows = t.logs.where("mitre_tactic <> ''").withColumn("mitre_tactic", F.concat("mitre_tactic", F.when(c("event_id") % 3 == 0, ", Impact").otherwise("")))
    return TE.tactic_volumes(rows)


@check("o613_telemetry_summary", f"""SELECT (SELECT count(*) FROM silence WHERE status<>'ok') AS silent_agents, (SELECT count(*) FROM silence) AS agents_total, {n('kind<>' + repr('binary_host') + f' AND first_ts >= {NOW} - INTERVAL 7 DAY')} AS novelties_7d,
 {_US('min(first_ts)', NOW)}/86400 < 14 AS learning_mode, (SELECT count(*) FROM beacons WHERE NOT likely_infra) AS beacons, (SELECT count(*) FROM policy_hits) AS policy_findings, (SELECT count(*) FROM cover WHERE process=0 OR auth=0 OR fim=0) AS blind_agents FROM ledger""")
def _(t):
    return TE.telemetry_summary(t.plogs, R.first_seen(t.plogs), AS_OF)


# --- risk ranking ---------------------------------------------------------------------

_W = "CASE severity WHEN 'critical' THEN 10.0::DOUBLE WHEN 'high' THEN 6.5::DOUBLE WHEN 'medium' THEN 3.5::DOUBLE WHEN 'low' THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END"


def _risk_sql(col, extra=""):
    return f"""WITH p AS (SELECT {col} AS entity, count(*) AS events, round(sum({_W}*exp(-0.6931471805::DOUBLE*date_diff('hour', ts, {NOW})/72)),2) AS points, max(rule_level) AS max_level, {n(S('critical'))} AS critical,
 count(DISTINCT dst_ip) AS uniq_dsts, max(ts) AS last_seen FROM logs WHERE ts >= {NOW} - INTERVAL 30 DAY {extra} GROUP BY 1 ORDER BY points DESC, entity LIMIT 50), q AS (SELECT *, round_even(points/max(points) OVER ()*100,0)::BIGINT AS score FROM p)
 SELECT entity, events, round_even(points,1) AS risk_points, score, CASE WHEN score>=80 THEN 'critical' WHEN score>=55 THEN 'high' WHEN score>=30 THEN 'medium' ELSE 'low' END AS band, max_level, critical, uniq_dsts, {ts('last_seen')} AS last_seen FROM q"""


@check("o324_entity_risk", _risk_sql("src_ip"))
def _(t):
    return RK.entity_risk(t.logs, as_of=AS_OF)


@check("o324_user_risk_ranking", _risk_sql("username", "AND username<>''"))
def _(t):
    return RK.entity_risk(t.logs, "user", as_of=AS_OF)


@check("o415_share_of_top", f"SELECT src_ip AS entity, count(*) AS events, round_even(count(*)/max(count(*)) OVER ()*100,0)::BIGINT AS score FROM logs GROUP BY 1")
def _(t):
    per = t.logs.groupBy(c("src_ip").alias("entity")).agg(F.count(F.lit(1)).alias("events")).withColumn("points", c("events").cast("double"))
    return RK.ranked(per).select("entity", "events", "score")


@check("o207_risk_with_disposition", f"SELECT r.entity, r.score, d.disposition FROM ({_risk_sql('src_ip')}) r LEFT JOIN latest_disp d USING (entity)")
def _(t):
    return RK.with_disposition(RK.entity_risk(t.logs, as_of=AS_OF), disp(t)).select("entity", "score", "disposition")


# --- indicators -----------------------------------------------------------------------

IOC_ROWS = [("85.11.187.0/24", "", "", "", 60, "internal blocklist"), ("203.0.113.55", "Actor A", "Campaign A", "Malware A", 85, "EXAMPLE"),
            ("185.220.101.", "Actor B", "", "", 70, "feed"), ("10.0.0.0/9", "", "Campaign C", "", 40, "feed"), ("host-1", "Actor D", "", "", 50, "feed"), ("203.0.113.64/26", "Actor A", "", "Malware E", 55, "feed"), ("10.2.3", "Actor F", "", "", 30, "feed")]
_IOC_VALUES = "(VALUES " + ", ".join(str(x) for x in IOC_ROWS) + ") i(indicator, actor, campaign, malware, confidence, source)"
_NUM = lambda a: f"(split_part({a},'.',1)::BIGINT*16777216+split_part({a},'.',2)::BIGINT*65536+split_part({a},'.',3)::BIGINT*256+split_part({a},'.',4)::BIGINT)"
define("all_ips", "SELECT DISTINCT src_ip AS ip FROM logs UNION SELECT DISTINCT agent FROM logs")
define("ioc_hits", f"""SELECT ip, indicator, actor, campaign, malware, confidence, source FROM all_ips, {_IOC_VALUES} WHERE CASE WHEN NOT regexp_matches(ip,'^[0-9.]+$') OR ends_with(indicator,'.') OR indicator='10.2.3' OR indicator='host-1' THEN starts_with(ip, indicator)
 WHEN contains(indicator,'/') THEN {_NUM('ip')} // CAST(pow(2, 32-split_part(indicator,'/',2)::INT) AS BIGINT) = {_NUM("split_part(indicator,'/',1)")} // CAST(pow(2, 32-split_part(indicator,'/',2)::INT) AS BIGINT) ELSE ip=indicator END""")


def iocs(t):
    return t.spark.createDataFrame(IOC_ROWS, "indicator string, actor string, campaign string, malware string, confidence int, source string")


def all_ips(t):
    return t.logs.select(F.explode(F.array("src_ip", "agent")).alias("ip")).distinct()


@check("o208_indicator_matches", "SELECT ip, indicator FROM ioc_hits")
def _(t):
    return N.matched(all_ips(t), iocs(t)).select("ip", "indicator")


define("rep_feat", f"SELECT src_ip, count(*) AS total, {n(S('critical'))} AS crit, {n(S('high'))} AS high, {n(S('medium'))} AS med, {n(S('low'))} AS low, max(rule_level) AS max_level, count(DISTINCT dst_port) AS uniq_ports, count(DISTINCT dst_ip) AS uniq_dsts, count(DISTINCT nullif(username,'')) AS uniq_users FROM logs GROUP BY 1")
define("rep", """SELECT *, CASE WHEN score>=70 THEN 'malicious' WHEN score>=40 THEN 'suspicious' WHEN score>=15 THEN 'watch' ELSE 'benign' END AS verdict FROM (SELECT *, round_even((crit*1.0::DOUBLE+high*0.65::DOUBLE+med*0.35::DOUBLE+low*0.10::DOUBLE)/greatest(1,crit+high+med+low)*55
 + (CASE WHEN uniq_ports>5 OR uniq_dsts>10 THEN least(20, greatest(0,uniq_ports-5)*2+greatest(0,uniq_dsts-10)) ELSE 0 END) + least(15,max_level) + least(10.0::DOUBLE, round_even(log10(total+1)*4,0)),0)::BIGINT AS score FROM rep_feat)""")


@check("o614_reputation", "SELECT src_ip, score, verdict, (crit>0)::INT+(high>0)::INT+(uniq_ports>5 OR uniq_dsts>10)::INT+(max_level>=12)::INT+(uniq_users>1)::INT AS factors FROM rep")
def _(t):
    return N.reputation(FE.reputation_features(t.logs)).select("src_ip", "score", "verdict", F.size("factors").alias("factors"))


define("rep_verdict", """SELECT src_ip, disposition, score AS model_score, CASE WHEN disposition IN ('false_positive','benign') THEN least(score,10) ELSE score END AS score,
 CASE WHEN disposition IN ('false_positive','benign') THEN 'benign (analyst-confirmed)' WHEN disposition IN ('true_positive','escalate') THEN replace(disposition,'_',' ')||' (analyst-confirmed)' ELSE verdict END AS verdict FROM rep LEFT JOIN latest_disp ON entity=src_ip""")


@check("o615_reputation_with_verdict", "SELECT * FROM rep_verdict")
def _(t):
    return N.with_verdict(N.reputation(FE.reputation_features(t.logs)), disp(t)).select("src_ip", "disposition", "model_score", "score", "verdict")


@check("o616_address_intel", f"""SELECT v.src_ip, v.score, kb AS is_known_bad, CASE WHEN kb AND h.rel IS NULL THEN 1 ELSE coalesce(h.rel,0) END AS relations, coalesce(h.actors,'') AS actors, CASE WHEN kb AND h.rel IS NULL THEN 60 ELSE h.conf END AS confidence FROM
 (SELECT *, ({' OR '.join(f"starts_with(src_ip,'{p}')" for p in X.KNOWN_BAD_PREFIXES)}) AS kb FROM rep_verdict) v LEFT JOIN (SELECT ip, count(*) AS rel, array_to_string(list_sort(list(DISTINCT nullif(actor,''))),',') AS actors, max(confidence) AS conf FROM ioc_hits GROUP BY 1) h ON h.ip=v.src_ip""")
def _(t):
    return N.address_intel(t.logs, iocs(t), disp(t)).select("src_ip", "score", "is_known_bad", "relations", F.array_join("actors", ",").alias("actors"), "confidence")


# --- kill chain -------------------------------------------------------------------------

_SC = ", ".join(f"{n(S(x))} AS {x}" for x in ("critical", "high", "medium", "low"))
define("placed_rows", f"""SELECT event_id, ts, src_ip, severity, coalesce(nullif(mitre_tactic,''), {_TACTIC('ids[1]')}, 'Unknown') AS tactic, coalesce(ids[1], mitre) AS technique FROM plogs JOIN ({IDS_SQL}) USING (threat_type, mitre, rule_groups)""")
define("stage_rows", f"SELECT src_ip, tactic, {TACTIC_RANK('tactic')}::BIGINT AS rank, count(*) AS events, min(ts) AS first_seen, max(ts) AS last_seen, {_SC} FROM placed_rows GROUP BY src_ip, tactic")
define("chain_rows", """SELECT src_ip, array_to_string(list(tactic ORDER BY rank, first_seen, tactic),'>') AS progression, first(tactic ORDER BY rank DESC, first_seen) AS max_stage, max(rank) AS stage_rank, max(rank)>=9 AS reached_lateral, count(*) AS tactics,
 sum(events)::BIGINT AS total_events, min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(critical)::BIGINT AS critical, sum(high)::BIGINT AS high, sum(medium)::BIGINT AS medium FROM stage_rows GROUP BY 1""")


def cell(t):
    return KC.cells(t.plogs)


@check("o617_stages", f"SELECT src_ip, tactic, rank, events, {ts('first_seen')} AS first_seen, {ts('last_seen')} AS last_seen, critical, high, medium, low FROM stage_rows")
def _(t):
    return KC.stages(cell(t))


@check("o617_stage_techniques", "SELECT src_ip, tactic, technique, count(*) AS events, row_number() OVER (PARTITION BY src_ip, tactic ORDER BY count(*) DESC, technique) AS position FROM placed_rows WHERE technique<>'' GROUP BY 1,2,3")
def _(t):
    return KC.stage_techniques(cell(t)).select("src_ip", "tactic", "technique", "events", "position")


@check("o617_chains", f"SELECT src_ip, progression, max_stage, stage_rank, reached_lateral, total_events, {ts('first_seen')} AS first_seen FROM chain_rows")
def _(t):
    return KC.chains(KC.stages(cell(t))).select("src_ip", F.array_join("progression", ">").alias("progression"), "max_stage", "stage_rank", "reached_lateral", "total_events", "first_seen")


@check("o618_phases", f"""SELECT src_ip, phase, num, events IS NOT NULL AS reached, coalesce(events,0) AS events, coalesce(tactics,'') AS tactics, {ts('first_seen')} AS first_seen FROM (SELECT * FROM (SELECT DISTINCT src_ip FROM stage_rows), (SELECT unnest([{','.join(repr(p) for p in X.PHASES)}]) AS phase, generate_subscripts([1,2,3,4,5,6,7],1) AS num))
 LEFT JOIN (SELECT src_ip, {_map_sql(X.PHASE_OF_TACTIC, 'tactic')} AS phase, sum(events)::BIGINT AS events, array_to_string(list_sort(list(tactic)),',') AS tactics, min(first_seen) AS first_seen FROM stage_rows GROUP BY 1,2) USING (src_ip, phase)""")
def _(t):
    return KC.phases(KC.stages(cell(t))).select("src_ip", "phase", "num", "reached", "events", F.array_join("tactics", ",").alias("tactics"), "first_seen")


_AL, _BL = "action='allowed'", "action IN ('blocked','denied')"


@check("o619_firewall_outcome", f"""SELECT src_ip, count(*) AS events, {n("action<>''")} AS acted, {n(_AL)} AS allowed, {n(_BL)} AS blocked, CASE WHEN {n("action<>''")}=0 THEN 'observed' WHEN {n(_BL)}>0 AND {n(_AL)}=0 THEN 'blocked' WHEN {n(_BL)}>0 THEN 'partial' ELSE 'allowed' END AS status,
 array_to_string(list_sort(list(DISTINCT dst_ip) FILTER (WHERE {_BL} AND dst_ip<>'')),',') AS blocked_ips FROM plogs GROUP BY 1""")
def _(t):
    return KC.firewall_outcome(t.plogs).select("src_ip", "events", "acted", "allowed", "blocked", "status", F.array_join("blocked_ips", ",").alias("blocked_ips"))


@check("o619_blocking_rules", f"SELECT src_ip, rule_id, rule AS policy, max(rule_level) AS level, count(*) AS events FROM logs WHERE {_BL} GROUP BY 1,2,3 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, rule_id, rule)<=5")
def _(t):
    return KC.blocking_rules(t.logs)


@check("o620_path_facts", f"""SELECT src_ip, count(*) AS events, count(DISTINCT nullif(dst_ip,'')) AS destinations, count(DISTINCT nullif(agent,'')) AS agents, any_value(top) AS top_dst FROM logs JOIN
 (SELECT src_ip, dst_ip AS top FROM logs WHERE dst_ip<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_ip DESC)=1) USING (src_ip) GROUP BY 1""")
def _(t):
    return KC.path_facts(t.logs).select("src_ip", "events", "destinations", "agents", "top_dst")


@check("o213_path_with_topology", """SELECT src_ip, top_dst, CASE WHEN top_dst LIKE '10.1.%' THEN 'sw-'||top_dst ELSE '' END AS switch FROM (SELECT src_ip, dst_ip AS top_dst FROM logs WHERE dst_ip<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, dst_ip DESC)=1)""")
def _(t):
    topo = t.logs.where("dst_ip like '10.1.%'").select(c("dst_ip").alias("ip")).distinct().withColumn("attrs", F.create_map(F.lit("switch"), F.concat(F.lit("sw-"), "ip")))
    return KC.path_facts(t.logs, topo).select("src_ip", "top_dst", "switch")


define("wave_rows", f"SELECT src_ip, date_trunc('hour',ts) AS hour, count(*) AS events, coalesce(array_to_string(list_sort(list(DISTINCT mitre_tactic) FILTER (WHERE mitre_tactic<>'')),','),'') AS tactics, CASE WHEN bool_or({S('critical')}) THEN 'critical' WHEN bool_or({S('high')}) THEN 'high' WHEN bool_or({S('medium')}) THEN 'medium' ELSE 'low' END AS peak_severity FROM logs GROUP BY 1,2")


@check("o621_waves", f"SELECT * REPLACE ({ts('hour')} AS hour) FROM wave_rows")
def _(t):
    return KC.waves(t.logs).withColumn("tactics", F.array_join("tactics", ","))


@check("o622_targeted_accounts", "SELECT src_ip, account, count(*) AS hits FROM (SELECT src_ip, unnest([username, target_user]) AS account FROM logs) WHERE account<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, account)<=10")
def _(t):
    return KC.targeted_accounts(t.logs)


@check("o623_top_rules", "SELECT src_ip, rule_id AS rule_key, count(*) AS events, first(rule ORDER BY ts) AS rule, first(severity ORDER BY ts) AS severity FROM logs WHERE rule<>'' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY count(*) DESC, rule_id)<=8")
def _(t):
    return KC.top_rules(t.logs)


@check("o624_velocity", f"SELECT src_ip, round_even(sum(events)/count(*),1) AS avg_per_hour, strftime(first(hour ORDER BY events DESC, hour),'%Y-%m-%d %H:%M:%S.%f') AS peak_hour, max(events) AS peak_count, count(*) AS hours_active FROM wave_rows GROUP BY 1")
def _(t):
    return KC.velocity(KC.waves(t.logs))


@check("o416_technique_chain", f"SELECT src_ip, mitre AS technique, count(*) AS events, {ts('min(ts)')} AS first_seen, row_number() OVER (PARTITION BY src_ip ORDER BY min(ts), mitre) AS position FROM logs WHERE mitre<>'' GROUP BY 1,2")
def _(t):
    return KC.technique_chain(t.logs).select("src_ip", "technique", "events", "first_seen", "position")


# --- coverage, brief ------------------------------------------------------------------------

_KBV = "(VALUES " + ", ".join(f"({i}, '{x[0]}', '{x[1]}', '{x[2]}', {x[4]!r})" for i, x in enumerate(X.TECHNIQUES)) + ") kb(position, technique, name, tactic, mitigations)"
_TM = "CASE threat_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TECHNIQUE_OF_THREAT.items()) + " END"
define("coverage_rows", f"""SELECT technique, name, tactic, {TACTIC_RANK('tactic')}::BIGINT AS tactic_rank, coalesce(events,0) AS events, coalesce(events,0)>0 AS covered FROM {_KBV} LEFT JOIN (SELECT t AS technique, sum(e)::BIGINT AS events FROM
 (SELECT unnest(string_split_regex(upper(mitre),'[,\\s]+')) AS t, 1 AS e FROM logs WHERE mitre<>'' AND ts >= {NOW} - INTERVAL 90 DAY UNION ALL SELECT {_TM}, 1 FROM logs WHERE threat_type NOT IN ('unknown','')) GROUP BY 1) USING (technique)""")


def coverage(t):
    return KC.attack_coverage(t.spark, R_(t), K.technique_counts(t.logs, 90, AS_OF))


@check("o632_attack_coverage", "SELECT * FROM coverage_rows")
def _(t):
    return coverage(t)


@check("o217_techniques_with_volume", "SELECT technique, events FROM coverage_rows")
def _(t):
    return coverage(t).select("technique", "events")


@check("o632_coverage_summary", f"SELECT count(*) AS techniques_total, {n('covered')} AS techniques_covered, round_even({n('covered')}/count(*)*100,0)::BIGINT AS coverage_pct FROM coverage_rows")
def _(t):
    return KC.coverage_summary(coverage(t))


define("brief_steps", f"""SELECT src_ip, base, tactic_rank AS tr, stage_first AS sf, events AS ev, mitigations FROM (SELECT *, min(first_seen) OVER (PARTITION BY src_ip, tactic) AS stage_first, string_split(technique,'.')[1] AS base, {TACTIC_RANK('tactic')} AS tactic_rank
 FROM (SELECT src_ip, tactic, technique, count(*) AS events, min(ts) AS first_seen FROM placed_rows GROUP BY 1,2,3)) s JOIN (SELECT technique AS kt, mitigations FROM {_KBV}) ON kt=base QUALIFY row_number() OVER (PARTITION BY src_ip, base ORDER BY tactic_rank, stage_first, events DESC)=1""")


@check("o642_grounded_brief", """SELECT src_ip, array_to_string(list(base ORDER BY tr, sf, ev DESC, base),',') AS techniques, any_value(ms) AS mitigations FROM brief_steps JOIN
 (SELECT src_ip, array_to_string(list(m ORDER BY pl, m)[1:8],',') AS ms FROM (SELECT src_ip, m, min({'a': tr, 'b': sf, 'c': -ev, 'd': i}) AS pl FROM (SELECT *, unnest(mitigations) AS m, generate_subscripts(mitigations,1) AS i FROM brief_steps) GROUP BY 1,2) GROUP BY 1) USING (src_ip) GROUP BY 1""")
def _(t):
    return KC.grounded_brief(t.spark, cell(t)).select("src_ip", F.array_join("techniques", ",").alias("techniques"), F.array_join("mitigations", ",").alias("mitigations"))


@check("o464_unique_mitigations", "SELECT src_ip, count(DISTINCT m) AS mitigations FROM (SELECT src_ip, unnest(mitigations) AS m FROM brief_steps) GROUP BY 1")
def _(t):
    return KC.grounded_brief(t.spark, cell(t), keep=100).select("src_ip", F.size("mitigations").alias("mitigations"))


# --- incidents --------------------------------------------------------------------------------

_INC = _REC + """, fi AS (SELECT ip, count(*) FILTER (WHERE kind='a') AS takeovers, count(*) FILTER (WHERE kind='t') AS travels, list(DISTINCT username) AS users FROM (SELECT src_ip AS ip, 'a' AS kind, username FROM ato_rows UNION ALL SELECT unnest([ip1, ip2]), 't', username FROM trav) WHERE ip<>'' GROUP BY 1),
 cand AS (SELECT ip, max(risk) AS risk FROM (SELECT ip, risk_score AS risk FROM latest_score UNION ALL SELECT DISTINCT src_ip, 0 FROM logs WHERE severity IN ('critical','high') UNION ALL SELECT ip, 0 FROM fi) GROUP BY 1),
 sig AS (SELECT ch.*, ip, risk, coalesce(takeovers,0) AS takeovers, coalesce(travels,0) AS travels, coalesce(users,[]) AS users FROM chain_rows ch JOIN cand ON ip=src_ip LEFT JOIN fi USING (ip)),
 gate AS (SELECT * FROM sig WHERE risk>=50 OR tactics>=2 OR takeovers+travels>0 OR critical>0 OR high>0),
 net AS (SELECT *, array_to_string(string_split(ip,'.')[1:3],'.') AS net FROM gate),
 tac AS (SELECT net, count(DISTINCT t) AS tactics FROM (SELECT net, unnest(string_split(progression,'>')) AS t FROM net) GROUP BY 1),
 inc AS (SELECT net, count(*) AS ip_count, min(ip) AS ip0, max(risk) AS risk, sum(total_events)::BIGINT AS total_events, bool_or(reached_lateral) AS reached_lateral, sum(takeovers)::BIGINT AS takeovers, sum(travels)::BIGINT AS travels, min(first_seen) AS first_seen,
  CASE WHEN max(critical)>0 THEN 'critical' WHEN max(high)>0 THEN 'high' WHEN max(medium)>0 THEN 'medium' ELSE 'low' END AS severity, array_to_string(list_sort(list_distinct(flatten(list(users)))), ',') AS users, array_to_string(list_sort(list(ip)), ',') AS ips, any_value(tac.tactics) AS tactics FROM net JOIN tac USING (net) GROUP BY net),
 prio AS (SELECT *, CASE WHEN ip_count>1 THEN 'campaign:'||net||'.0/24' ELSE 'host:'||ip0 END AS incident_id, greatest(0, least(100, round_even(risk*0.45::DOUBLE + least(tactics,8)*5 + least(ip_count,10)*2.5::DOUBLE + CASE WHEN reached_lateral THEN 20 ELSE 0 END + takeovers*15 + travels*10 + CASE WHEN severity='critical' THEN 10 ELSE 0 END,0)))::BIGINT AS priority FROM inc) """


def find(t):
    return I.findings_by_ip(ato(t), travel(t))


def sig(t):
    from wardlight.session import checkpointed
    found = checkpointed(t.spark, find(t))
    cells = cell(t)
    return I.signals(cells, KC.chains(KC.stages(cells)), I.candidates(scores(t), K.hot_ips(R_(t)), found), found)


@check("o212_candidates", _INC + "SELECT ip, risk FROM cand")
def _(t):
    return I.candidates(scores(t), K.hot_ips(R_(t)), find(t))


@check("o625_signals", _INC + "SELECT ip, risk, max_stage, progression, takeovers, travels, total_events FROM sig")
def _(t):
    return sig(t).select("ip", "risk", "max_stage", F.array_join("progression", ">").alias("progression"), "takeovers", "travels", "total_events")


@check("o626_gated_signals", _INC + "SELECT ip FROM gate")
def _(t):
    return I.gated(sig(t)).select("ip")


@check("o627_incidents", _INC + f"SELECT incident_id, ip_count, risk, total_events, reached_lateral, severity, takeovers, travels, users, ips, tactics, {ts('first_seen')} AS first_seen FROM prio")
def _(t):
    return I.correlate(I.gated(sig(t))).select("incident_id", "ip_count", "risk", "total_events", "reached_lateral", "severity", "takeovers", "travels", F.array_join("users", ",").alias("users"), F.array_join("ips", ",").alias("ips"), F.size("tactics").alias("tactics"), "first_seen")


@check("o628_priority", _INC + "SELECT incident_id, priority FROM prio")
def _(t):
    return I.correlate(I.gated(sig(t))).select("incident_id", "priority")


@check("o629_narrative")
def _(t):
    return I.with_narrative(I.correlate(I.gated(sig(t)))).select("incident_id", "priority", "narrative")


_KW = {p[0]: [v for k, v in p[3] if k == "keyword"] for p in X.PLAYBOOKS}
# matchable text of an incident: technique names and tactics (its narrative repeats these; its own words hold no keyword but "lateral", of chains that got there)
_PB = _INC + f""", tt AS (SELECT net, lower(string_agg(DISTINCT coalesce(technique,''), ' ')) AS ids, lower(string_agg(DISTINCT coalesce({_NAME('technique')},''), ' ')) AS names, lower(string_agg(DISTINCT tactic, ' ')) AS tacs, bool_or(tactic='Lateral Movement') AS lat
  FROM (SELECT n.net, p.* FROM net n JOIN placed_rows p ON p.src_ip=n.ip) GROUP BY 1),
 hit AS (SELECT incident_id, 'pb-brute-force' AS playbook_id, 'high' AS playbook_severity FROM prio JOIN tt USING (net) WHERE contains(ids,'t1110') OR regexp_matches(names||' '||tacs,'brute|auth|login_fail|password')
  UNION ALL SELECT incident_id, 'pb-lateral', 'critical' FROM prio JOIN tt USING (net) WHERE reached_lateral OR lat OR regexp_matches(ids,'t1021|t1210|t1570') OR regexp_matches(names||' '||tacs,'lateral|sensitive_port|rdp|smb|ssh')
  UNION ALL SELECT incident_id, 'pb-identity', 'critical' FROM prio WHERE takeovers+travels>0) """


def matches(t):
    return I.match_playbooks(I.with_narrative(I.correlate(I.gated(sig(t)))))


@check("o630_playbook_matches", _PB + "SELECT incident_id, playbook_id, row_number() OVER (PARTITION BY incident_id ORDER BY playbook_severity='critical' DESC, CASE playbook_id WHEN 'pb-brute-force' THEN 0 WHEN 'pb-lateral' THEN 1 ELSE 2 END) AS place FROM hit")
def _(t):
    return matches(t).select("incident_id", "playbook_id", "place")


@check("o218_trigger_reasons", _PB + "SELECT playbook_id, count(*) AS incidents FROM hit GROUP BY 1")
def _(t):
    return matches(t).groupBy("playbook_id").agg(F.count(F.lit(1)).alias("incidents"))


_STEPS = "(VALUES " + ", ".join(f"('{p[0]}', {i + 1}, '{a}', {ap})" for p in X.PLAYBOOKS for i, (a, ap) in enumerate(p[4])) + ") st(playbook_id, step, action, approval)"


@check("o631_plan_steps", _PB + f"SELECT incident_id, playbook_id, step, action, CASE WHEN approval THEN 'requires_approval' ELSE 'done' END AS status FROM hit JOIN {_STEPS} USING (playbook_id)")
def _(t):
    return I.plan_steps(t.spark, matches(t)).select("incident_id", "playbook_id", "step", "action", "status")


@check("o631_run_ledger", _PB + f"SELECT incident_id, playbook_id, count(*) AS steps, CASE WHEN bool_or(approval) THEN 'suggested' ELSE 'done' END AS status FROM hit JOIN {_STEPS} USING (playbook_id) GROUP BY 1,2")
def _(t):
    return I.run_ledger(I.plan_steps(t.spark, matches(t))).select("incident_id", "playbook_id", "steps", "status")
