"""Row-level expressions (section 2.2 of the survey)."""

from pyspark.sql import functions as F

from wardlight import schema
from wardlight.functions import columns as C, times as T
from wardlight.functions import fixed as X

from .registry import NOW, check, ts

c = F.col


def _case(groups, col, otherwise):
    """SQL text of an ordered keyword choice."""
    arms = " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in words) + f" THEN '{name}'"
                    for name, words in groups)
    return f"CASE {arms} ELSE {otherwise} END"


def _any(words, col):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


@check("o102_first_filled", "SELECT event_id, coalesce(nullif(nullif(target_user,''),'None'), "
       "nullif(nullif(policy_id,''),'None'), nullif(nullif(proc_image,''),'None'), '') AS picked FROM logs")
def _(t):
    return t.logs.select("event_id", C.first_filled(c("target_user"), c("policy_id"), c("proc_image")).alias("picked"))


@check("o103_event_time", f"""SELECT event_id, {ts("date_trunc('second', ts) - CASE event_id%4 WHEN 2 THEN INTERVAL 330 MINUTE ELSE INTERVAL 0 MINUTE END")} AS parsed FROM logs""")
def _(t):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(c("event_id") % 4 == 0, F.concat(stamp, F.lit("Z")))
            .when(c("event_id") % 4 == 1, F.concat(stamp, F.lit("+0000")))
            .when(c("event_id") % 4 == 2, F.concat(stamp, F.lit("+05:30"))).otherwise(stamp))
    return t.logs.select("event_id", C.event_time(text).alias("parsed"))


@check("o104_source_address", """SELECT event_id, CASE WHEN event_id%7<>0 THEN src_ip WHEN event_id%14=0 THEN dst_ip END AS ip FROM logs""")
def _(t):
    rows = t.logs.select("event_id", F.when(c("event_id") % 7 == 0, F.element_at(F.array(F.lit("NaN"), F.lit(" none "), F.lit("")), (c("event_id") % 3 + 1).cast("int"))).otherwise(c("src_ip")).alias("data.srcip"),
                         F.when(c("event_id") % 14 == 0, c("dst_ip")).otherwise("unknown").alias("agent.ip"))
    return rows.select("event_id", C.source_address(rows.columns).alias("ip"))


@check("o105_entity_columns", "SELECT agent AS entity, count(*) AS events FROM logs GROUP BY agent")
def _(t):
    return t.logs.groupBy(c(schema.entity_column("agent")).alias("entity")).agg(F.count(F.lit(1)).alias("events"))


@check("o106_severity_of_level", "SELECT event_id, severity FROM logs")
def _(t):
    return t.logs.select("event_id", C.severity_of_level(c("rule_level")).alias("severity"))


@check("o107_stream_threat", f"SELECT event_id, {_case(X.STREAM_THREAT_WORDS, 'h', chr(39) + 'unknown' + chr(39))} AS threat "
       "FROM (SELECT event_id, lower(rule_groups || ' ' || rule || ' ' || '') AS h FROM logs)")
def _(t):
    return t.logs.select("event_id", C.stream_threat(c("rule_groups"), c("rule"), F.lit("")).alias("threat"))


def _flat_sql():
    f, hi = _any(X.FLAT_FAILURE_WORDS, "h"), "greatest(r, 2)"
    arms = [(_any(X.FLAT_SUCCESS_WORDS, "h"), "login_success", "r"),
            (f + " AND " + _any(X.FLAT_SSH_WORDS, "h"), "ssh_bruteforce", hi),
            (f + " AND " + _any(X.FLAT_VPN_WORDS, "h"), "vpn_bruteforce", hi),
            (f + " AND " + _any(X.FLAT_RDP_WORDS, "h"), "rdp_relay", hi), (f, "brute_force", hi),
            (_any(X.FLAT_RDP_WORDS, "h"), "rdp_relay", hi)]
    for kind, words, floor in X.FLAT_INTENTS:
        arms.append((_any(words, "h"), kind, f"greatest(r, {X.SEVERITIES.index(floor)})" if floor else "r"))
    arms += [(_any(X.FLAT_POLICY_WORDS, "h"), "policy_violation", "0")]
    kinds = " ".join(f"WHEN {w} THEN '{k}'" for w, k, _ in arms)
    ranks = " ".join(f"WHEN {w} THEN {r}" for w, _, r in arms)
    return f"""SELECT event_id, CASE {kinds} ELSE 'unknown' END AS threat_type,
 ['low','medium','high','critical'][(CASE {ranks} ELSE r END)+1] AS severity
 FROM (SELECT event_id, lower(rule_groups || ' ' || rule || ' ' || mitre_tactic || ' ' || action) AS h,
  CASE WHEN event_id%5=0 THEN ['3','2','1','0','0'][event_id%4+1]::INT ELSE
  CASE WHEN rule_level>=12 THEN 3 WHEN rule_level>=8 THEN 2 WHEN rule_level>=4 THEN 1 ELSE 0 END END AS r FROM logs)"""


@check("o108_flat_class", _flat_sql())
def _(t):
    word = F.element_at(F.array(*map(F.lit, ["alert", "Warning", "notice", "information"])), (c("event_id") % 4 + 1).cast("int"))
    level = F.when(c("event_id") % 5 == 0, word).otherwise(c("rule_level").cast("string"))
    text = C.flat_text([c("rule_groups"), c("rule"), c("mitre_tactic"), c("action")])
    return t.logs.select("event_id", C.flat_class(text, level).alias("v")).select("event_id", "v.*")


@check("o111_level_filter", "SELECT event_id FROM logs WHERE rule_level >= 7 OR (rule_level >= 4 AND event_id % 10 = 0)")
def _(t):
    from wardlight.sources.alerts import kept_levels
    return t.logs.where(kept_levels(c("rule_level"), c("event_id"), 4, 7, 10)).select("event_id")


@check("o112_minute_cap", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY ts, event_id) AS r FROM logs) WHERE r <= 2")
def _(t):
    from wardlight.sources.alerts import capped_per_minute
    return capped_per_minute(t.logs, 2, ["ts", "event_id"]).select("event_id")


@check("o113_internal_address", """SELECT event_id, (src_ip LIKE '10.%' OR src_ip LIKE '192.168.%' OR regexp_matches(src_ip, '^172[.](1[6-9]|2[0-9]|3[01])[.]')) AS inside FROM logs""")
def _(t):
    return t.logs.select("event_id", C.is_internal(c("src_ip")).alias("inside"))


@check("o114_subnet24", """SELECT event_id, CASE WHEN len(string_split(a,'.'))=4 THEN array_to_string(string_split(a,'.')[1:3],'.') ELSE '' END AS net,
 CASE WHEN len(string_split(a,'.'))=4 THEN array_to_string(string_split(a,'.')[1:3],'.') ELSE a END AS net_or_self
 FROM (SELECT event_id, CASE WHEN event_id%9=0 THEN agent ELSE src_ip END AS a FROM logs)""")
def _(t):
    a = F.when(c("event_id") % 9 == 0, c("agent")).otherwise(c("src_ip"))
    return t.logs.select("event_id", C.subnet24(a).alias("net"), C.subnet24(a, a).alias("net_or_self"))


@check("o115_known_bad", f"""SELECT event_id, ({' OR '.join(f"starts_with(src_ip,'{p}')" for p in X.KNOWN_BAD_PREFIXES)}) AS known_bad,
 ({' OR '.join(f"starts_with(src_ip,'{p}')" for p in X.SCORING_BAD_PREFIXES)}) AS scoring_bad FROM logs""")
def _(t):
    return t.logs.select("event_id", C.is_known_bad(c("src_ip")).alias("known_bad"),
                         C.has_prefix(c("src_ip"), X.SCORING_BAD_PREFIXES).alias("scoring_bad"))


def _map_sql(values, col):
    return "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " ELSE '' END"


@check("o116_port_labels", f"SELECT event_id, {_map_sql(X.SENSITIVE_PORTS, 'dst_port')} AS sensitive, {_map_sql(X.SERVICE_PORTS, 'dst_port')} AS service FROM logs")
def _(t):
    return t.logs.select("event_id", C.sensitive_service(c("dst_port")).alias("sensitive"), C.service_name(c("dst_port")).alias("service"))


@check("o117_action_sets", f"""SELECT event_id, lower(a) IN {_in(X.ALLOWED_ACTIONS)} AS allowed, lower(a) IN {_in(X.BLOCKED_ACTIONS)} AS blocked,
 a IN {_in(X.BLOCKED_ACTIONS)} AS blocked_exact FROM (SELECT event_id, CASE WHEN event_id%3=0 THEN upper(action) ELSE action END AS a FROM logs)""")
def _(t):
    a = F.when(c("event_id") % 3 == 0, F.upper("action")).otherwise(c("action"))
    return t.logs.select("event_id", C.is_allowed(a).alias("allowed"), C.is_blocked(a).alias("blocked"), C.is_blocked(a, True).alias("blocked_exact"))


@check("o118_destination_name", "SELECT event_id, coalesce(nullif(json_extract_string(raw,'$.data.url'),''),'') AS destination FROM logs")
def _(t):
    return t.logs.select("event_id", C.destination_name(c("url"), c("raw")).alias("destination"))


@check("o119_raw_identity", "SELECT event_id, coalesce(json_extract_string(raw,'$.id'),'') AS alert_id, coalesce(json_extract_string(raw,'$.timestamp'),'') AS ts_raw FROM logs")
def _(t):
    return t.logs.select("event_id", C.raw_text(c("raw"), "$.id").alias("alert_id"), C.raw_text(c("raw"), "$.timestamp").alias("ts_raw"))


@check("o120_raw_process", "SELECT event_id, coalesce(json_extract_string(raw,'$.data.policyid'),'') AS policy_id_r, coalesce(json_extract_string(raw,'$.data.win.eventdata.image'),'') AS proc_image_r FROM logs")
def _(t):
    r = C.raw_process(c("raw"))
    return t.logs.select("event_id", *[r[k].alias(k) for k in ("policy_id_r", "proc_image_r")])


_PID = "coalesce(nullif(policy_id,''), nullif(json_extract_string(raw,'$.data.policyid'),''), regexp_extract(full_log,'policyid=\"?([0-9]+)',1))"


@check("o121_policy_of", f"SELECT event_id, coalesce(nullif(policy_id,''), CASE WHEN event_id%2=0 THEN json_extract_string(raw,'$.data.policyid') END, regexp_extract(full_log,'policyid=\"?([0-9]+)',1)) AS pid FROM logs")
def _(t):
    raw = F.when(c("event_id") % 2 == 0, c("raw")).otherwise("{}")
    return t.logs.select("event_id", C.policy_of(c("policy_id"), raw, c("full_log")).alias("pid"))


@check("o122_firewall_rows", "SELECT event_id FROM logs WHERE decoder ILIKE '%fortigate%' OR decoder ILIKE '%firewall%' OR rule_groups ILIKE '%firewall%' OR rule ILIKE '%fortigate%' OR location ILIKE '%fortigate%'")
def _(t):
    return t.logs.where(C.is_firewall_row(c("decoder"), c("rule_groups"), c("rule"), c("location"))).select("event_id")


_SRC = _case(X.LOG_SOURCE_WORDS, "h", "CASE WHEN trim(action)<>'' THEN 'firewall' ELSE 'endpoint' END")


@check("o123_log_source", f"SELECT event_id, {_SRC} AS log_source FROM (SELECT event_id, action, lower(rule_groups||' '||rule||' '||agent||' '||mitre) AS h FROM logs)")
def _(t):
    return t.logs.select("event_id", C.log_source(c("rule_groups"), c("rule"), c("agent"), c("mitre"), c("action")).alias("log_source"))


_FALL = "CASE WHEN trim(rule)<>'' THEN 'Uncategorized: '||substr(trim(rule),1,48) ELSE 'Other Activity' END"
_TITLE = "list_reduce(list_transform(string_split(replace(threat_type,'_',' '),' '), lambda w: upper(w[1])||lower(w[2:])), lambda a, b: a||' '||b)"


@check("o124_threat_label", f"""SELECT event_id, CASE WHEN threat_type<>'' AND threat_type<>'unknown' THEN {_TITLE}
 ELSE {_case(X.THREAT_LABEL_WORDS, 'h', _FALL)} END AS label FROM (SELECT *, lower(rule||' '||rule_groups) AS h FROM plogs)""")
def _(t):
    return t.plogs.select("event_id", C.threat_label(c("threat_type"), c("rule"), c("rule_groups")).alias("label"))


_MACH = lambda u: f"(trim({u})<>'' AND (ends_with(trim({u}),'$') OR (agent<>'' AND lower(trim({u}))=lower(trim(agent)))))"


@check("o125_machine_account", f"SELECT event_id, {_MACH('username')} AS machine FROM plogs")
def _(t):
    return t.plogs.select("event_id", C.is_machine_account(c("username"), c("agent")).alias("machine"))


@check("o126_entity", f"""SELECT event_id, CASE WHEN u IS NOT NULL THEN 'user:'||u WHEN agent<>'' THEN 'host:'||agent ELSE 'ip:'||src_ip END AS id,
 CASE WHEN u IS NOT NULL THEN 'user' WHEN agent<>'' THEN CASE WHEN regexp_matches(lower(agent),'^agent-[0-9]+$') THEN 'sensor' ELSE 'host' END ELSE 'ip' END AS kind,
 u IS NOT NULL AS has_user FROM (SELECT event_id, agent, src_ip, CASE WHEN username<>'' AND NOT {_MACH('username')} THEN username
  WHEN target_user<>'' AND NOT {_MACH('target_user')} THEN target_user END AS u FROM
  (SELECT event_id, username, target_user, src_ip, CASE WHEN event_id%11=0 THEN 'Agent-'||(event_id%7) ELSE agent END AS agent FROM plogs))""")
def _(t):
    rows = t.plogs.withColumn("agent", F.when(c("event_id") % 11 == 0, F.concat(F.lit("Agent-"), (c("event_id") % 7).cast("string"))).otherwise(c("agent")))
    e = C.entity_of(c("username"), c("target_user"), c("agent"), c("src_ip"))
    return rows.select("event_id", e.alias("e")).select("event_id", "e.id", c("e.type").alias("kind"), "e.has_user")


@check("o127_event_key", f"""SELECT event_id, 'EVT-'||upper(substr(sha256(concat_ws('|', {ts('ts')}, src_ip, dst_ip, dst_port, rule_id, rule_level,
 threat_type, agent, username, rule)),1,12)) AS event_key FROM logs""")
def _(t):
    return t.logs.select("event_id", C.event_key(c("ts"), *[c(f) for f in C.EVENT_KEY_FIELDS]).alias("event_key"))


@check("o128_enriched", f"""SELECT event_id, CASE WHEN {_MACH('username')} THEN '' ELSE username END AS user_display,
 proc_image AS process, json_extract_string(raw,'$.data.policyid') AS policy, json_extract_string(raw,'$.data.url') AS destination,
 json_extract_string(raw,'$.id') AS alert_id FROM logs""")
def _(t):
    return C.enriched(t.logs).select("event_id", "user_display", "process", "policy", "destination", "alert_id")


_HAV = lambda a, b, x, y: (f"(6371.0::DOUBLE*2*atan2(sqrt(pow(sin(radians({x}-{a})/2),2)+cos(radians({a}))*cos(radians({x}))*pow(sin(radians({y}-{b})/2),2)),"
                           f"sqrt(1-(pow(sin(radians({x}-{a})/2),2)+cos(radians({a}))*cos(radians({x}))*pow(sin(radians({y}-{b})/2),2)))))")


@check("o129_haversine", f"SELECT event_id, round({_HAV('geo_lat', 'geo_lon', '22.4::DOUBLE', '78.7::DOUBLE')}, 4) AS km FROM logs")
def _(t):
    return t.logs.select("event_id", F.round(C.haversine_km(c("geo_lat"), c("geo_lon"), F.lit(22.4), F.lit(78.7)), 4).alias("km"))


CENTROIDS = "(VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in X.COUNTRY_CENTROIDS.items()) + ") cc(cname, clat, clon)"


@check("o130_event_place", f"""SELECT event_id, CASE WHEN abs(geo_lat)>0.01 OR abs(geo_lon)>0.01 THEN geo_lat ELSE clat END AS lat,
 CASE WHEN abs(geo_lat)>0.01 OR abs(geo_lon)>0.01 THEN geo_lon ELSE clon END AS lon FROM plogs LEFT JOIN {CENTROIDS} ON cname=trim(country)""")
def _(t):
    return t.plogs.select("event_id", C.place_of(c("geo_lat"), c("geo_lon"), c("country")).alias("p")).select("event_id", "p.lat", "p.lon")


TACTIC_RANK = lambda col: f"(coalesce(list_position([{', '.join(repr(x) for x in X.TACTICS)}], {col}), {len(X.TACTICS) + 1}) - 1)"


@check("o131_tactic_rank_phase", f"SELECT event_id, {TACTIC_RANK('mitre_tactic')}::BIGINT AS tactic_rank, {_map_sql(X.PHASE_OF_TACTIC, 'mitre_tactic')} AS phase FROM logs")
def _(t):
    return t.logs.select("event_id", C.tactic_rank(c("mitre_tactic")).cast("long").alias("tactic_rank"), C.phase_of(c("mitre_tactic")).alias("phase"))


_KB = _in([x[0] for x in X.TECHNIQUES])
_NAME = lambda col: "CASE " + col + " " + " ".join(f"WHEN '{x[0]}' THEN '{x[1]}'" for x in X.TECHNIQUES) + " END"
_TACTIC = lambda col: "CASE " + col + " " + " ".join(f"WHEN '{x[0]}' THEN '{x[2]}'" for x in X.TECHNIQUES) + " END"


@check("o132_technique_lookup", f"SELECT event_id, b AS technique, {_NAME('b')} AS name FROM (SELECT event_id, CASE WHEN b IN {_KB} THEN b END AS b FROM (SELECT event_id, string_split(upper(trim(mitre)),'.')[1] AS b FROM logs))")
def _(t):
    b = C.technique_base(c("mitre"))
    return t.logs.select("event_id", b.alias("technique"), C.technique_name(b).alias("name"))


_TT = "CASE tt " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TECHNIQUE_OF_THREAT.items()) + " END"
_SEC = "CASE tt " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in X.SECOND_TECHNIQUES.items()) + " ELSE [] END"
_ALIASES = "[" + ", ".join(f"{{'w': '{w}', 't': '{i}'}}" for w, i in C._alias_words()) + "]"
# ordered technique ids of each distinct (threat, mitre, groups)
IDS_SQL = f"""SELECT threat_type, mitre, rule_groups, list_filter(list_concat(
  list_transform(string_split_regex(upper(mitre), '[,; ]'), lambda x: CASE WHEN string_split(trim(x),'.')[1] IN {_KB} THEN string_split(trim(x),'.')[1] END),
  [{_TT}], {_SEC}, list_transform(list_filter({_ALIASES}, lambda a: contains(h, a.w)), lambda a: a.t)), lambda x: x IS NOT NULL) AS ids
 FROM (SELECT DISTINCT threat_type, mitre, rule_groups, lower(threat_type) AS tt, lower(threat_type||' '||rule_groups) AS h FROM plogs)"""


@check("o133_alert_techniques", f"""SELECT event_id, pos, tid FROM (
  SELECT event_id, tid, row_number() OVER (PARTITION BY event_id ORDER BY min(i)) AS pos FROM (
   SELECT p.event_id, unnest(ids) AS tid, generate_subscripts(ids, 1) AS i FROM plogs p JOIN ({IDS_SQL}) d USING (threat_type, mitre, rule_groups))
  GROUP BY event_id, tid)""")
def _(t):
    ids = C.techniques_of(c("threat_type"), c("mitre"), c("rule_groups"))
    return t.plogs.select("event_id", F.posexplode(ids).alias("p", "tid")).select("event_id", (c("p") + 1).alias("pos"), "tid")


@check("o134_event_tactic", f"""SELECT event_id, coalesce(nullif(mitre_tactic,''), {_TACTIC('ids[1]')}, 'Unknown') AS tactic,
 coalesce(ids[1], mitre) AS technique FROM plogs JOIN ({IDS_SQL}) USING (threat_type, mitre, rule_groups)""")
def _(t):
    lead = C.lead_technique(c("threat_type"), c("mitre"), c("rule_groups"))
    return t.plogs.select("event_id", C.tactic_of(c("mitre_tactic"), lead).alias("tactic"),
                          F.coalesce(lead, c("mitre")).alias("technique"))


@check("o135_span_text", """SELECT event_id, CASE WHEN s<60 THEN s||'s' WHEN s<3600 THEN (s//60)||'m' WHEN s<86400 THEN (s//3600)||'h '||(s%3600//60)||'m'
 ELSE (s//86400)||'d '||(s%86400//3600)||'h' END AS span, printf('%02d:%02d', (hour(ts)*60+330)%1440//60, (hour(ts)*60+330)%1440%60) AS local_hour
 FROM (SELECT event_id, ts, event_id*37%300000 AS s FROM logs)""")
def _(t):
    return t.logs.select("event_id", T.span_text(c("event_id") * 37 % 300000).alias("span"), T.india_hour(F.hour("ts")).alias("local_hour"))


@check("o136_bands", """SELECT event_id, CASE WHEN k>=80 THEN 'critical' WHEN k>=60 THEN 'high' WHEN k>=35 THEN 'medium' ELSE 'low' END AS risk,
 CASE WHEN k>=80 THEN 'critical' WHEN k>=55 THEN 'high' WHEN k>=30 THEN 'medium' ELSE 'low' END AS entity,
 CASE WHEN k>=70 THEN 'critical' WHEN k>=45 THEN 'high' WHEN k>=25 THEN 'medium' ELSE 'low' END AS person,
 CASE WHEN k>=70 THEN 'malicious' WHEN k>=40 THEN 'suspicious' WHEN k>=15 THEN 'watch' ELSE 'benign' END AS verdict FROM logs""")
def _(t):
    return t.events.select("event_id", C.band(c("k"), C.RISK_BANDS, "low").alias("risk"), C.band(c("k"), C.ENTITY_BANDS, "low").alias("entity"),
                           C.band(c("k"), C.USER_BANDS, "low").alias("person"), C.band(c("k"), C.VERDICT_BANDS, "benign").alias("verdict"))


@check("o138_segment_label", """SELECT event_id, CASE WHEN a LIKE '10.%' THEN CASE split_part(a,'.',2) WHEN '0' THEN 'Server Farm / Core Network' WHEN '1' THEN 'Floor 1'
 WHEN '2' THEN 'Floor 2' WHEN '3' THEN 'Floor 3' WHEN '200' THEN 'Management Network' ELSE 'Internal Segment (10.'||split_part(a,'.',2)||'.x.x)' END
 WHEN split_part(a,'.',1) IN ('172','192') THEN 'Internal Network' END AS segment
 FROM (SELECT event_id, CASE WHEN event_id%6=0 THEN '192.168.1.1' WHEN event_id%6=1 THEN '10.77.0.1' WHEN event_id%6=2 THEN src_ip ELSE dst_ip END AS a FROM logs)""")
def _(t):
    m = c("event_id") % 6
    a = F.when(m == 0, "192.168.1.1").when(m == 1, "10.77.0.1").when(m == 2, c("src_ip")).otherwise(c("dst_ip"))
    return t.logs.select("event_id", C.segment_label(a).alias("segment"))


@check("o139_threat_kinds", f"SELECT DISTINCT threat_type, {_any(X.NETWORK_THREAT_WORDS, 'threat_type')} AS network, {_any(X.IDENTITY_THREAT_WORDS, 'threat_type')} AS identity FROM logs")
def _(t):
    return t.logs.select("threat_type").distinct().select("threat_type", C.is_network_threat(c("threat_type")).alias("network"), C.is_identity_threat(c("threat_type")).alias("identity"))
