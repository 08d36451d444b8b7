"""Sources, sinks and streams (2.1, 2.2, 2.7): alert lines and flat rows are made
from the log rows by Spark, then read back through the library."""

from pyspark.sql import functions as F

from wardlight.functions import columns as C, fixed as X
from wardlight.functions.times import since
from wardlight.operators import rollups as R
from wardlight.session import checkpointed, shared_folder
from wardlight.sources import alerts, flat, lookup, state as S, store
from wardlight.streaming import ingest as G
from wardlight.streaming.deviations import deviations_on_arrival

from .function_checks import _case, _flat_sql, _in
from .registry import AS_OF, NOW, SEV, check, n, ts

c = F.col


def _odd_rule():
    return F.when(c("event_id") % 5 == 1, F.concat(F.lit("[High] "), "rule")).otherwise(c("rule"))


def alert_lines(t, rows=None):
    """One JSON alert per log row; technique and group fields are lists.  Some texts
    begin like lists or objects, some users are lists, some actions are objects."""
    rows = t.logs if rows is None else rows
    split = lambda col, sep: F.filter(F.split(col, sep), lambda x: x != "")
    body = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'").alias("timestamp"), c("event_id").cast("string").alias("id"),
        F.struct(c("rule_id").alias("id"), c("rule_level").alias("level"), _odd_rule().alias("description"),
                 split("rule_groups", ",").alias("groups"),
                 F.struct(split("mitre", ", ").alias("id"), split("mitre_tactic", ", ").alias("tactic")).alias("mitre")).alias("rule"),
        F.struct(c("agent").alias("name")).alias("agent"),
        F.struct(F.when(c("event_id") % 50 != 0, c("src_ip")).alias("srcip"), c("dst_ip").alias("dstip"), c("dst_port").alias("dstport"),
                 F.when(c("event_id") % 13 == 0, F.parse_json(F.lit('{"deny": 1}'))).otherwise(c("action").cast("variant")).alias("action"),
                 c("country").alias("srccountry"),
                 F.when(c("event_id") % 11 == 3, F.to_variant_object(F.array("username", F.lit("second"))))
                 .otherwise(c("username").cast("variant")).alias("dstuser"),
                 F.nullif("policy_id", F.lit("")).alias("policyid")).alias("data"),
        F.struct(F.struct(c("geo_lat").cast("string").alias("lat"), c("geo_lon").cast("string").alias("lon")).alias("location")).alias("GeoLocation"),
        F.struct(c("decoder").alias("name")).alias("decoder"),
        F.when(c("event_id") % 5 == 2, F.concat(F.lit("{odd "), "full_log")).otherwise(c("full_log")).alias("full_log"))
    return checkpointed(t.spark, rows.select(F.to_json(body).alias("value")))


_GROUPS = "replace(rule_groups, ',', ', ')"
_STREAM = _case(X.STREAM_THREAT_WORDS, "h", "'unknown'")
_USER = "CASE WHEN event_id % 11 = 3 THEN username || ', second' ELSE username END"
_ROW = f"""src_ip, dst_ip, dst_port, {_STREAM} AS threat_type, severity, shown AS rule, rule_id, rule_level, CASE WHEN event_id % 13 = 0 THEN '' ELSE action END AS action,
 country, agent, mitre, {_USER} AS username, mitre_tactic, {_GROUPS} AS rule_groups, {_USER} AS target_user, geo_lat, geo_lon, decoder,
 CASE WHEN event_id % 5 = 2 THEN '{{odd ' || full_log ELSE full_log END AS full_log, policy_id, {ts('ts')} AS ts
 FROM (SELECT *, lower({_GROUPS}||' '||shown||' ') AS h FROM (SELECT *, CASE WHEN event_id % 5 = 1 THEN '[High] ' || rule ELSE rule END AS shown FROM logs)) WHERE event_id % 50 <> 0"""
_OUT = "src_ip dst_ip dst_port threat_type severity rule rule_id rule_level action country agent mitre username mitre_tactic rule_groups target_user geo_lat geo_lon decoder full_log policy_id ts".split()


@check("o101_alert_fields", f"SELECT event_id::VARCHAR AS id, {_GROUPS} AS groups, CAST(rule_level AS VARCHAR) AS level FROM logs")
def _(t):
    v = c("alert")
    return alerts.parsed(alert_lines(t)).select(alerts.field(v, "id").alias("id"), F.coalesce(alerts.field(v, "rule.groups"), F.lit("")).alias("groups"), alerts.field(v, "rule.level").alias("level"))


@check("o109_alert_rows", f"SELECT {_ROW}")
def _(t):
    return alerts.to_log_rows(alert_lines(t)).select(*_OUT)


@check("o002_alert_backfill", f"SELECT {_ROW}")
def _(t):
    folder = shared_folder(t.spark) + "/alerts"
    alert_lines(t).write.text(folder)
    return alerts.read_alerts(t.spark, folder).select(*_OUT)


def streamed(t, rows=None, cap=0):
    """Alert files to a store, through the stream, until all files are read."""
    root = shared_folder(t.spark)
    alert_lines(t, rows).repartition(3).write.text(root + "/alerts")
    rows = alerts.stream_alerts(t.spark, root + "/alerts", max_files=1)
    G.start(rows, root + "/store", root + "/checkpoint", available_now=True, cap=cap).awaitTermination()
    return root


@check("o001_streamed_alerts", f"SELECT {_ROW}")
def _(t):
    return G.read_table(t.spark, streamed(t) + "/store", "logs").select(*_OUT)


@check("o009_day_partitions", f"SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    path = shared_folder(t.spark) + "/logs"
    store.write_logs(t.logs, path)
    return store.read_logs(t.spark, path).groupBy("day").agg(F.count(F.lit(1)).alias("events"))


@check("o010_replayed_batch", "SELECT src_ip, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    root = shared_folder(t.spark)
    half = c("event_id") % 2 == 0
    for batch, rows in ((0, t.logs.where(half)), (1, t.logs.where(~half)), (1, t.logs.where(~half))):
        G.store_batch(rows.drop("event_id"), batch, root)
    return R.summed(G.read_table(t.spark, root, "agg_ip_daily"), R.DAILY_KEYS).groupBy("src_ip").agg(F.sum("events").alias("events"))


@check("o011_state_log", "SELECT ip, kind, active FROM latest_block")
def _(t):
    path = shared_folder(t.spark) + "/blocklist"
    rows = t.state["blocklist"]
    S.append_state(rows.where("event_id % 2 = 0"), path, "blocklist")
    S.append_state(rows.where("event_id % 2 = 1"), path, "blocklist")
    return S.latest(t.spark.read.parquet(path), "blocklist", "event_id").select("ip", "kind", "active")


FLAT = {"data.srcip": "src_ip", "data.dstip": "dst_ip", "data.dstport": "dst_port", "rule.description": "rule", "rule.id": "rule_id",
        "data.action": "action", "data.srccountry": "country", "agent.name": "agent", "rule.mitre.id": "mitre", "data.user": "username",
        "rule.mitre.tactic": "mitre_tactic", "rule.groups": "rule_groups", "syscheck.path": "sc_path", "decoder.name": "decoder", "full_log": "full_log"}


def flat_rows(t):
    return t.logs.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"), c("rule_level").cast("string").alias("rule.level"),
                         *[c(v).alias(k) for k, v in FLAT.items()])


_FLAT_OUT = "src_ip dst_ip dst_port rule rule_id action country agent mitre username mitre_tactic rule_groups sc_path decoder full_log rule_level threat_type severity ts".split()
_FLAT_SQL = f"SELECT l.src_ip, dst_ip, dst_port, rule, rule_id, action, country, agent, mitre, username, mitre_tactic, rule_groups, sc_path, decoder, full_log, rule_level, v.threat_type, v.severity, {ts('ts')} AS ts FROM logs l JOIN ({_flat_sql().replace('event_id%5=0', 'false')}) v USING (event_id)"


@check("o110_flat_rows", _FLAT_SQL)
def _(t):
    return flat.to_log_rows(flat_rows(t)).select(*_FLAT_OUT)


@check("o003_csv_upload", _FLAT_SQL)
def _(t):
    path = shared_folder(t.spark) + "/csv"
    flat_rows(t).write.option("header", True).csv(path)
    return flat.to_log_rows(flat.read_csv(t.spark, path)).select(*_FLAT_OUT)


@check("o004_json_body", "SELECT count(*) AS count, count(*) FILTER (WHERE event_id%10<>0) AS saved, count(*) FILTER (WHERE event_id%10=0) AS skipped FROM logs")
def _(t):
    path = shared_folder(t.spark) + "/json"
    rows = t.logs.select(c("event_id").cast("string").alias("id"), F.when(c("event_id") % 10 == 0, "none").otherwise(c("src_ip")).alias("data.srcip"), c("rule").alias("rule.description"))
    json_files(rows.select(F.struct("`data.srcip`", "`rule.description`").alias("row"), "id"), path, wrap=True)
    return flat.ingest_counts(flat.read_json_body(t.spark, path))


def json_files(rows, path, wrap=False):
    """Files of one JSON list each (rows spread over 64 files)."""
    grouped = rows.groupBy(F.pmod(F.hash("id"), F.lit(64)).alias("g")).agg(F.collect_list("row").alias("logs"))
    text = F.to_json(F.struct("logs") if wrap else F.col("logs"))
    grouped.select("g", text.alias("value")).write.partitionBy("g").text(path)


@check("o006_drop_folder", f"SELECT src_ip, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    root = shared_folder(t.spark)
    flat_rows(t).write.option("header", True).csv(root + "/in")
    G.start_folder(t.spark, root + "/in", "*.csv", root + "/store", root + "/checkpoint", available_now=True).awaitTermination()
    return G.read_table(t.spark, root + "/store", "logs").groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"))


@check("o005_single_rows", _FLAT_SQL)
def _(t):
    """Every row is a body of its own: an object, not a list."""
    path = shared_folder(t.spark) + "/rows"
    flat_rows(t).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return flat.to_log_rows(flat.read_json_lines(t.spark, path)).select(*_FLAT_OUT)


@check("o006_json_drop_folder", "SELECT src_ip, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    """Files of one JSON object a line."""
    root = shared_folder(t.spark)
    flat_rows(t).select(F.to_json(F.struct("*")).alias("value")).write.text(root + "/in")
    G.start_folder(t.spark, root + "/in", "*.txt", root + "/store", root + "/checkpoint", available_now=True).awaitTermination()
    return G.read_table(t.spark, root + "/store", "logs").groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"))


@check("o007_topology", "SELECT src_ip AS ip, first(agent ORDER BY event_id DESC) AS host, coalesce(nullif(first(target_user ORDER BY event_id DESC),''),'-') AS owner FROM logs GROUP BY 1")
def _(t):
    rows = t.logs.select(c("src_ip").alias(" IP Address"), c("agent").alias("Host Name "), c("target_user").alias("Owner"), c("event_id").alias("_place"))
    return lookup.topology_rows(rows).select("ip", c("attrs")["host_name"].alias("host"), F.coalesce(c("attrs")["owner"], F.lit("-")).alias("owner"))


@check("o008_indicators", "SELECT DISTINCT src_ip AS indicator, 40+length(src_ip) AS confidence FROM logs")
def _(t):
    path = shared_folder(t.spark) + "/iocs"
    rows = t.logs.select("src_ip").distinct()
    json_files(rows.select(c("src_ip").alias("id"), F.struct(c("src_ip").alias("indicator"), (F.length("src_ip") + 40).alias("confidence")).alias("row")), path)
    return lookup.read_indicators(t.spark, path).select("indicator", "confidence")


# --- streams ----------------------------------------------------------------------

_S = lambda sql: sql.replace("logs", "(SELECT * EXCLUDE (threat_type, rule_groups, target_user), " + _STREAM + f" AS threat_type FROM (SELECT *, lower({_GROUPS}||' '||rule||' ') AS h FROM logs) WHERE event_id % 50 <> 0) sl")


@check("o501_streamed_daily", _S("SELECT strftime(ts,'%Y-%m-%d') AS day, src_ip, threat_type, severity, count(*) AS events FROM logs GROUP BY ALL"))
def _(t):
    return R.summed(G.read_table(t.spark, streamed(t) + "/store", "agg_ip_daily"), R.DAILY_KEYS)


@check("o502_closed_hours", f"SELECT {ts('date_trunc(' + repr('hour') + ', ts)')} AS hour, threat_type, severity, count(*) AS events FROM logs WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM logs) - INTERVAL 1 HOUR GROUP BY ALL")
def _(t):
    root = shared_folder(t.spark)
    t.logs.repartitionByRange("ts").sortWithinPartitions("ts").write.parquet(root + "/in")
    # all files in one batch: they end in any order of time, and rows later than the delay are left out
    stream = t.spark.readStream.schema(t.logs.schema).parquet(root + "/in")
    q = (G.closed_hours(stream).writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/checkpoint")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(root + "/out")


@check("o503_streamed_ledger", _S("SELECT 'country' AS kind, country AS key, count(*) AS events FROM logs WHERE country<>'' GROUP BY 2 UNION ALL SELECT 'port', dst_port, count(*) FROM logs WHERE dst_port<>'' GROUP BY 2"))
def _(t):
    out = R.merged_first_seen(G.read_table(t.spark, streamed(t) + "/store", "first_seen"))
    return out.where("kind in ('country', 'port')").select("kind", "key", "events")


@check("o504_streamed_deviations", f"SELECT ip, event_id, {ts('ts')} AS ts, type, severity, detail FROM dev_found")
def _(t):
    """The last day streamed in six files, one a batch; each event judged on arrival."""
    root = shared_folder(t.spark)
    logs = t.plogs.drop("day")
    for part in range(6):
        bounds = [F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(24 - 4 * h)) for h in (part, part + 1)]
        last = F.lit(True) if part == 5 else c("ts") < bounds[1]
        since(t.plogs, bounds[0]).where(last).drop("day").coalesce(1).write.mode("append").parquet(root + "/in")
    stream = t.spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    found = deviations_on_arrival(stream, t.baselines, t.plogs, AS_OF, hours=24)
    query = (found.writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/checkpoint")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return (t.spark.read.schema(found.schema).parquet(root + "/out")
            .withColumn("detail", F.when(c("type") == "automated_tool_detected", "").otherwise(c("detail"))))


@check("o508_late_rows", "SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    root = shared_folder(t.spark)
    old = c("ts") < F.lit("2024-01-10")
    for batch, rows in enumerate((t.logs.where(~old), t.logs.where(old))):
        G.store_batch(rows.drop("event_id"), batch, root)
    return R.summed(G.read_table(t.spark, root, "agg_ip_daily"), R.DAILY_KEYS).groupBy("day").agg(F.sum("events").alias("events"))


@check("o509_without_repeats", "SELECT src_ip, count(*) AS events FROM logs GROUP BY 1")
def _(t):
    root = shared_folder(t.spark)
    t.logs.unionByName(t.logs.where("event_id % 3 = 0")).write.parquet(root + "/in")    # files grow in number, not in size
    stream = t.spark.readStream.schema(t.logs.schema).parquet(root + "/in")
    q = (G.without_repeats(stream).writeStream.format("parquet").option("path", root + "/out").option("checkpointLocation", root + "/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return t.spark.read.parquet(root + "/out").groupBy("src_ip").agg(F.count(F.lit(1)).alias("events"))
