"""Models, recommender, overview, report, resilience, refresh rules."""

from pyspark.sql import functions as F

from wardlight.functions import fixed as X
from wardlight.operators import counts as K, features as FE, forest as FO, recommend as RE, risk as RK
from wardlight.plans import report as RP

from .behaviour_checks import S, base, r
from .count_checks import R_, blocks, dev, disp, scores
from wardlight.session import shared_folder

from .registry import AS_OF, NOW, check, define, n, ts
from .risk_checks import I, sig

c = F.col
FEATS = ["n_events", "unique_dst_ips", "brute_force_cnt", "pct_critical"]


def features(t):
    return FE.window_features(t.plogs, K.alert_counts(dev(t)), as_of=AS_OF)


@check("o701_standardised", "SELECT ip, " + ", ".join(f"round((f.{x}-m_{x})/CASE WHEN s_{x}>0 THEN s_{x} ELSE 1 END,6) AS {x}" for x in FEATS) + " FROM win_feat f, (SELECT " + ", ".join(f"avg({x}) AS m_{x}, stddev_pop({x}) AS s_{x}" for x in FEATS) + " FROM win_feat)")
def _(t):
    return r(FO.standardised(features(t), FEATS), 6, *FEATS)


@check("o702_forest_scores")
def _(t):
    return r(FO.trained_scores(features(t)), 6, "anomaly_score")


@check("o703_scored_and_fused")
def _(t):
    return RK.fused_risk(features(t), FO.trained_scores(features(t)))


@check("o702_planted_outliers", "SELECT 'planted-'||i AS ip, true AS is_anomaly FROM range(5) AS t(i) WHERE (SELECT count(*) FROM logs) > 0")
def _(t):
    """Five rows far from all others are outliers, whatever the trees draw."""
    known = features(t)
    top = known.agg(*[(F.max(n) * 20 + 1000).alias(n) for n in X.FOREST_FEATURES])
    odd = top.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.concat(F.lit("planted-"), i.cast("string")))).alias("ip"), "*")
    rows = known.select("ip", *X.FOREST_FEATURES).unionByName(odd)
    return FO.trained_scores(rows).where("ip like 'planted-%'").select("ip", "is_anomaly")


@check("o703_rescored_by_a_saved_model", "SELECT ip, true AS scored FROM win_feat")
def _(t):
    """A model trained on the week before last, saved and read again, scores the last week."""
    from wardlight.operators import features as FE
    path = shared_folder(t.spark) + "/models"
    FO.write_model(FO.train_model(FE.window_features(t.plogs, as_of="2024-01-24 00:00:00")), path, 1)
    found = FO.scores_by(FO.read_model(t.spark, path), features(t))
    return found.select("ip", F.abs("anomaly_score").between(0, 1).alias("scored"))


_BAD = " OR ".join(f"starts_with(ip,'{p}')" for p in X.SCORING_BAD_PREFIXES)
define("fused", f"""SELECT *, CASE WHEN is_anomaly THEN greatest(tot,50) ELSE tot END AS risk_score FROM (SELECT *, greatest(0, least(100, ap+dp+ip_pts)) AS tot FROM (SELECT ip, is_anomaly, greatest(0, least(55, CAST(trunc((0.5::DOUBLE-anomaly_score)*55) AS INT))) AS ap,
 least(40, baseline_alerts*3+critical_alerts*8) AS dp, CASE WHEN {_BAD} THEN 25 ELSE 0 END AS ip_pts FROM (SELECT ip, coalesce(baseline_alerts,0) AS baseline_alerts, coalesce(critical_alerts,0) AS critical_alerts FROM win_feat LEFT JOIN dev_counts USING (ip)) JOIN latest_score USING (ip)))""")


@check("o704_fused_risk", "SELECT ip, risk_score, CASE WHEN risk_score>=80 THEN 'critical' WHEN risk_score>=60 THEN 'high' WHEN risk_score>=35 THEN 'medium' ELSE 'low' END AS band, ap AS anomaly_points, dp AS deviation_points, ip_pts AS intel_points FROM fused")
def _(t):
    return RK.fused_risk(features(t), scores(t).select("ip", "anomaly_score", "is_anomaly")).select("ip", "risk_score", "band", "anomaly_points", "deviation_points", "intel_points")


@check("o705_address_scores", f"""SELECT ip, coalesce(CASE WHEN s.risk_score%2=0 THEN s.risk_score END, CASE WHEN f.risk_score%3=0 THEN f.risk_score END, CASE WHEN {_BAD} THEN 25 END) AS risk_score,
 CASE WHEN s.risk_score%2=0 THEN 'stored' WHEN f.risk_score%3=0 THEN 'live' WHEN {_BAD} THEN 'intel_only' ELSE 'not_found' END AS source FROM (SELECT DISTINCT src_ip AS ip FROM logs) LEFT JOIN latest_score s USING (ip) LEFT JOIN fused f USING (ip)""")
def _(t):
    live = RK.fused_risk(features(t), scores(t).select("ip", "anomaly_score", "is_anomaly")).where("risk_score % 3 = 0")
    return RK.address_scores(t.logs.select(c("src_ip").alias("ip")).distinct(), scores(t).where("risk_score % 2 = 0"), live)


_LF = f"""SELECT entity, disposition, ln(1+greatest(1,events)) AS log_events, max_lvl/15.0::DOUBLE AS max_level, avg_lvl/15.0::DOUBLE AS avg_level, crit/greatest(1,events)::DOUBLE AS frac_critical, high/greatest(1,events)::DOUBLE AS frac_high, ln(1+uniq_dst) AS log_uniq_dst,
 ln(1+uniq_ports) AS log_uniq_ports, ln(1+uniq_users) AS log_uniq_users, CASE WHEN entity IN (SELECT ip FROM latest_score WHERE is_anomaly) THEN 1.0 ELSE 0.0 END AS is_anomaly, CASE WHEN disposition IN ('true_positive','escalate') THEN 1.0 ELSE 0.0 END AS label FROM entity_vec JOIN latest_disp USING (entity)"""


def train(t):
    feats = FE.entity_features(t.logs, disp(t))
    return RE.training_rows(feats, disp(t), scores(t).where("is_anomaly"))


@check("o706_label_features", "SELECT entity, disposition, label::DOUBLE AS label, " + ", ".join(f"round({x}::DOUBLE,6) AS {x}" for x in X.LABEL_FEATURES) + f" FROM ({_LF})")
def _(t):
    return r(train(t).drop("top_threat"), 6, *X.LABEL_FEATURES)


@check("o204_labelled_features", "SELECT entity, disposition, events FROM entity_vec JOIN latest_disp USING (entity)")
def _(t):
    return FE.entity_features(t.logs, disp(t)).join(disp(t).select("entity", "disposition"), "entity").select("entity", "disposition", "events")


@check("o205_unlabelled", "SELECT DISTINCT src_ip FROM logs WHERE src_ip NOT IN (SELECT entity FROM latest_disp WHERE disposition='benign')")
def _(t):
    done = disp(t).where("disposition = 'benign'").select(c("entity").alias("src_ip"))
    return t.logs.select("src_ip").distinct().join(done, "src_ip", "left_anti")


@check("o707_label_status", f"SELECT count(*) AS labels, {n('label=1')} AS pos, {n('label=0')} AS neg, CASE WHEN count(*)>=24 AND {n('label=1')}>=6 AND {n('label=0')}>=6 THEN 'ready' ELSE 'collecting' END AS status FROM ({_LF})")
def _(t):
    return RE.label_status(train(t))


def _bundle(t):
    return RE.train_labels(train(t))


def confidence(t):
    bundle = _bundle(t)
    if bundle["model"] is None:
        return t.spark.createDataFrame([], "threat_type string, confidence double")
    rows = RE.featurised(FE.entity_features(t.logs), scores(t).where("is_anomaly"))
    return RE.threat_confidence(RE.probabilities(bundle, rows))


@check("o707_label_model")
def _(t):
    b = _bundle(t)
    return t.spark.createDataFrame([(b["labels"], b["status"], b.get("train_accuracy"), b.get("weights") or {})], "labels long, status string, train_accuracy double, weights map<string,double>")


@check("o708_threat_confidence")
def _(t):
    return r(confidence(t), 4, "confidence")


_REC = f"""SELECT threat_type, count(*) AS events, count(DISTINCT src_ip) AS ips, max(rule_level) AS max_lvl, {n(S('critical'))} AS crit FROM logs WHERE ts >= {NOW} - INTERVAL 30 DAY AND threat_type<>'' GROUP BY 1"""
_COV = "(threat_type IN ('ssh_bruteforce','vpn_bruteforce','brute_force','rdp_relay') OR regexp_matches(replace(threat_type,'_',' ')||' '||threat_type,'brute|auth|login_fail|password|lateral|sensitive_port|rdp|smb|ssh'))"


@check("o709_recommendations", f"""SELECT threat_type, events, ips, crit, round_even(conf,3) AS tp_confidence, round_even(ln(1+events)*conf*(1.0::DOUBLE+crit/greatest(1,events)::DOUBLE*1.5::DOUBLE)*(1+ln(1+ips)),2) AS rank_score FROM (SELECT *, 0.5::DOUBLE+max_lvl/40.0::DOUBLE AS conf FROM ({_REC}))
 WHERE threat_type NOT IN ('','unknown','login_success','successful_login','other') AND NOT {_COV} AND events>=30 AND conf>=0.5""")
def _(t):
    rec = K.threat_recurrence(t.logs, 30, AS_OF)
    conf = rec.select("threat_type", (F.lit(0.5) + c("max_lvl") / 40.0).alias("confidence"))
    return RE.recommendations(rec, conf, RE.covered_threats(rec)).select("threat_type", "events", "ips", "crit", "tp_confidence", "rank_score")


@check("o709_model_recommendations")
def _(t):
    rec = K.threat_recurrence(t.logs, 30, AS_OF)
    return RE.recommendations(rec, confidence(t), RE.covered_threats(rec), threshold=0.0)


@check("o710_covered_threats", f"SELECT DISTINCT threat_type FROM logs WHERE {_COV}")
def _(t):
    return RE.covered_threats(t.logs)


_words = lambda ws: "regexp_matches(threat_type,'" + "|".join(ws) + "')"


@check("o711_draft_responses", f"SELECT DISTINCT threat_type, 'enrich_reputation,enrich_abuseipdb,tag_entity'||CASE WHEN {_words(X.IDENTITY_THREAT_WORDS)} THEN ',disable_user' ELSE '' END||CASE WHEN {_words(X.NETWORK_THREAT_WORDS)} THEN ',block_ip' ELSE '' END||',open_case,notify' AS steps, CASE threat_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in X.TECHNIQUE_OF_THREAT.items())} END AS technique FROM logs")
def _(t):
    return RE.draft_responses(t.logs).select("threat_type", F.array_join(F.transform("steps", lambda s: s["action"]), ",").alias("steps"), "technique")


@check("o712_label_queue", f"""SELECT r.threat_type, r.events, r.ips, {_COV.replace('threat_type', 'r.threat_type')} AS covered, e.entity AS example_entity FROM ({_REC}) r JOIN (SELECT threat_type, src_ip AS entity FROM logs WHERE threat_type<>'' AND ts >= {NOW} - INTERVAL 30 DAY AND
 src_ip NOT IN (SELECT entity FROM latest_disp WHERE disposition='benign') GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY threat_type ORDER BY count(*) DESC, src_ip)=1) e USING (threat_type) WHERE r.threat_type NOT IN ('','unknown','login_success','successful_login','other') ORDER BY r.events DESC, r.threat_type LIMIT 12""")
def _(t):
    rec = K.threat_recurrence(t.logs, 30, AS_OF)
    ex = RE.label_examples(t.logs, disp(t).where("disposition = 'benign'"), 30, AS_OF)
    return RE.label_queue(rec, RE.covered_threats(rec), ex).select("threat_type", "events", "ips", "covered", "example_entity")


# --- overview, report, rules -------------------------------------------------------

_STATS = f"""SELECT 'total_logs' AS part, '' AS key, count(*) AS value FROM logs UNION ALL SELECT 'unique_ips','',count(DISTINCT src_ip) FROM logs UNION ALL SELECT 'total_alerts','',count(*) FROM latest_dev
 UNION ALL SELECT 'threat_counts', threat_type, count(*) FROM logs WHERE threat_type NOT IN ('unknown','') GROUP BY threat_type UNION ALL SELECT 'severity_counts', severity, count(*) FROM logs GROUP BY severity
 UNION ALL SELECT 'hot_ips', src_ip, count(*) FROM logs WHERE severity IN ('critical','high') GROUP BY src_ip UNION ALL SELECT 'alert_types', type, count(*) FROM latest_dev GROUP BY type
 UNION ALL SELECT DISTINCT 'critical_ips', ip, 1 FROM latest_dev WHERE severity='critical'"""


@check("o334_global_statistics", _STATS)
def _(t):
    return RP.global_statistics(R_(t), dev(t))


@check("o641_overview", f"SELECT * FROM ({_STATS}) WHERE part IN ('total_logs','unique_ips','hot_ips')")
def _(t):
    return RP.overview(R_(t), t.logs, dev(t))["statistics"].where("part in ('total_logs', 'unique_ips', 'hot_ips')")


@check("o013_storage_overview", "SELECT count(*) AS total_logs, count(DISTINCT src_ip) AS unique_ips, (SELECT count(*) FROM base_scalar) AS baselines, (SELECT count(*) FROM latest_dev) AS deviations FROM logs")
def _(t):
    from wardlight.operators.baseline import baseline_scalars
    from wardlight.functions.times import ago, moment, until
    return RP.storage_overview(R_(t), baseline_scalars(until(t.plogs, ago(moment(AS_OF), hours=24))), dev(t))


_WK = f"logs WHERE ts >= {NOW} - INTERVAL 7 DAY"
_HOT = f"(SELECT src_ip FROM {_WK} AND severity IN ('critical','high') GROUP BY 1 ORDER BY count(*) DESC, src_ip LIMIT 10)"


@check("o634_report", f"""SELECT 'threat' AS part, threat_type AS key, events AS value FROM (SELECT threat_type, count(*) AS events FROM {_WK} AND threat_type NOT IN ('unknown','') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6)
 UNION ALL SELECT 'ip:'||replace(first(threat_type ORDER BY n DESC, threat_type DESC),'_',' '), src_ip, sum(n)::BIGINT FROM (SELECT src_ip, threat_type, count(*) AS n FROM {_WK} AND src_ip IN {_HOT} GROUP BY 1,2) GROUP BY src_ip
 UNION ALL SELECT 'severity', severity, count(*) FROM {_WK} AND src_ip IN {_HOT} GROUP BY severity UNION ALL SELECT 'total', '', count(*) FROM {_WK}
 UNION ALL SELECT 'auto', '', count(*) FROM latest_block WHERE active=1 AND kind='auto'""")
def _(t):
    tables = RP.report_tables(t.logs, dev(t), blocks(t), t.spark.createDataFrame([], "incident_id string, priority long"), "weekly", AS_OF)
    row = lambda df, part, key, value: df.select(part.alias("part"), key.alias("key"), value.cast("long").alias("value"))
    lit = F.lit
    return (row(tables["top_threats"], lit("threat"), c("threat_type"), c("events"))
            .unionByName(row(tables["top_ips"], F.concat(lit("ip:"), "driver"), c("src_ip"), c("events")))
            .unionByName(row(tables["severities"], lit("severity"), c("severity"), c("events")))
            .unionByName(row(tables["posture"], lit("total"), lit(""), c("total_logs")))
            .unionByName(row(tables["posture"], lit("auto"), lit(""), c("auto_blocked"))))


@check("o633_resilience", f"""SELECT *, ml_points+baseline_points+pressure_points+response_points AS score, CASE WHEN ml_points+baseline_points+pressure_points+response_points>=80 THEN 'A' WHEN ml_points+baseline_points+pressure_points+response_points>=65 THEN 'B' WHEN ml_points+baseline_points+pressure_points+response_points>=50 THEN 'C'
  WHEN ml_points+baseline_points+pressure_points+response_points>=35 THEN 'D' ELSE 'F' END AS grade FROM (SELECT active_ips, events_7d, greatest(0, 25-critical*3)::BIGINT AS pressure_points, round_even(least(100,round_even(scored/greatest(active_ips,1)*100,0))*0.25::DOUBLE,0)::BIGINT AS ml_points,
  round_even(least(100,round_even(baselined/greatest(active_ips,1)*100,0))*0.25::DOUBLE,0)::BIGINT AS baseline_points, round_even(least(100,round_even(blocked/greatest(critical+flagged,1)*100,0))*0.25::DOUBLE,0)::BIGINT AS response_points
  FROM (SELECT (SELECT count(DISTINCT src_ip) FROM logs WHERE ts > {NOW} - INTERVAL 7 DAY) AS active_ips, (SELECT count(*) FROM logs WHERE ts > {NOW} - INTERVAL 7 DAY) AS events_7d, (SELECT count(*) FROM base_scalar) AS baselined, (SELECT count(*) FROM latest_score) AS scored,
  (SELECT count(*) FROM latest_score WHERE risk_score>=70) AS critical, (SELECT count(*) FROM latest_block WHERE active=1) AS blocked, (SELECT count(DISTINCT ip) FROM deviations WHERE ts > {NOW} - INTERVAL 7 DAY) AS flagged))""")
def _(t):
    from wardlight.operators.baseline import baseline_scalars
    from wardlight.functions.times import ago, moment, until
    b = baseline_scalars(until(t.plogs, ago(moment(AS_OF), hours=24)))
    out = RK.resilience(t.logs, b, scores(t), blocks(t), t.state["deviations"], AS_OF)
    return out.select("active_ips", "events_7d", c("pressure_points").cast("long").alias("pressure_points"), "ml_points", "baseline_points", "response_points", c("score").cast("long").alias("score"), "grade")


@check("o506_refresh_due", f"SELECT count(*) AS new_rows, count(*)>=200 AS due FROM logs WHERE ts > {NOW} - INTERVAL 2 DAY")
def _(t):
    batches = t.logs.groupBy(F.date_trunc("minute", "ts").alias("m")).agg(F.count(F.lit(1)).alias("rows"), F.max("ts").alias("arrived_at"))
    return RP.refresh_due(batches, "2024-01-29 00:00:00", AS_OF, 200)


@check("o507_retrain_due", f"SELECT round(date_diff('microsecond', max(ts), {NOW})/3.6e9,6) AS hours, (SELECT count(*) FROM logs)-10 AS new_rows, true AS due, true AS enough FROM logs WHERE event_id%2=0")
def _(t):
    reg = t.logs.where("event_id % 2 = 0").select(c("ts").alias("trained_at"), F.lit(10).cast("long").alias("rows"))
    total = t.logs.agg(F.count(F.lit(1)).alias("n"))
    return r(RP.retrain_due(reg, total, total, AS_OF, hours=0), 6, "hours")
