"""Log rows and state logs derived from the driver's ``events`` table.

Integer arithmetic only, so any SQL engine gives the same rows.  A few planted
scenarios are added to the derived rows for detectors that evenly random data
cannot trigger.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as C
from ..schema import LOG_FIELDS
from ..session import in_utc

AS_OF = "2024-01-31 00:00:00"

_N = "cast(regexp_extract(props, '([0-9]+)', 1) as bigint)"


def base_events(spark: SparkSession, folder: str) -> DataFrame:
    in_utc(spark)
    return (spark.read.parquet(f"{folder}/events.parquet")
            .select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
                    F.expr(_N).alias("k")))


def _pick(number: Column, *values) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def logs(spark: SparkSession, folder: str, keep=()) -> DataFrame:
    """One log row per event, in the 41-column layout plus ``event_id`` (and any
    source columns named in ``keep``)."""
    c, lit, when = F.col, F.lit, F.when
    ev = base_events(spark, folder).withColumn("level", (c("event_id") * 7 + c("k")) % 16)
    u, k, kind = c("user_id"), c("k"), c("event_type")
    tail = (u % 250 + 1).cast("string")
    text = lambda n: n.cast("string")
    threat = (when(kind == "error", _pick(k % 4, "ssh_bruteforce", "brute_force", "vpn_bruteforce", "rdp_relay"))
              .when(kind == "signup", "login_success")
              .when(kind == "click", _pick(k % 2, "web_attack", "recon_scan"))
              .when(kind == "purchase", _pick(k % 3, "db_scan", "privilege_escalation", "known_malicious"))
              .when(k % 3 == 0, "malware").otherwise("unknown"))
    policy_no = text(k % 12)
    values = {
        "event_id": c("event_id"),
        "ts": c("ts"),
        "ingested_at": c("ts"),
        "src_ip": when(u % 25 == 0, F.concat(lit("85.11.187."), tail))
        .when(u % 25 == 1, F.concat(lit("185.220.101."), tail))
        .when(u % 5 == 0, F.concat(lit("203.0.113."), tail))
        .otherwise(F.concat(lit("10."), text(u % 4), lit("."), text(u % 7), lit("."), tail)),
        "dst_ip": F.concat(lit("10."), text(c("event_id") % 4), lit(".0."), text(k % 20 + 1)),
        "dst_port": _pick(k % 10, "22", "3389", "443", "53", "3306", "5432", "8080", "445", "123", ""),
        "threat_type": threat,
        "severity": C.severity_of_level(c("level")),
        "rule": F.concat(lit("Rule "), text(c("level")), lit(": "), threat),
        "rule_id": text(k + 80000),
        "rule_level": c("level").cast("smallint"),
        "action": _pick(k % 4, "allowed", "blocked", "denied", ""),
        "country": _pick((u + when(k < 3, k + 1).otherwise(0)) % 6,
                         "India", "Russia", "China", "United States", "Germany", ""),
        "agent": F.concat(lit("host-"), text(u % 30)),
        "mitre": when(kind == "error", "T1110.001")
        .when(kind == "click", _pick(k % 2, "T1190", "T1046"))
        .when(kind == "purchase", when(k % 3 == 1, "T1068").otherwise("T1071, T1041")).otherwise(""),
        "username": when(u % 20 == 0, F.concat(lit("HOST"), text(u), lit("$")))
        .otherwise(F.concat(lit("user"), text(u))),
        "mitre_tactic": when(kind == "error", "Credential Access")
        .when(kind == "purchase", when(k % 3 == 1, "Privilege Escalation").otherwise("Command and Control"))
        .when((kind == "click") & (k % 2 == 0), "Initial Access").otherwise(""),
        "rule_groups": when(kind == "error", "authentication_failed,sshd")
        .when(kind == "signup", "authentication_success").when(kind == "click", "web,attack")
        .when(kind == "purchase", "firewall").otherwise("syscheck"),
        "proc_image": when(k % 8 == 0, F.concat(lit("/bin/p"), text(k))).otherwise(""),
        "logon_type": when(kind == "signup", "3").otherwise(""),
        "target_user": when(k % 10 == 0, F.concat(lit("user"), text((u + 1) % 150))).otherwise(""),
        "sc_path": when((kind == "view") & (k % 2 == 0), F.concat(lit("/etc/f"), text(k))).otherwise(""),
        "geo_lat": when(k % 7 == 0, (k - 50).cast("double")).otherwise(0.0),
        "geo_lon": when(k % 7 == 0, (c("event_id") % 360 - 180).cast("double")).otherwise(0.0),
        "decoder": when(kind == "purchase", "fortigate-firewall").otherwise("json"),
        "full_log": F.concat(lit("date=x policyid="), policy_no),
        "raw": F.concat(lit('{"id":"'), text(c("event_id")), lit('","data":{"policyid":"P'), policy_no,
                        lit('","url":"h'), text(k % 9), lit('.example.com"}}')),
        "policy_id": when((kind == "purchase") & (k % 5 != 0), F.concat(lit("P"), policy_no)).otherwise(""),
    }
    return ev.select(*[_filled(values, n, t) for n, t in [("event_id", "bigint"), *LOG_FIELDS]], *keep)


def _filled(values: dict, name: str, kind: str) -> Column:
    empty = F.lit("") if kind == "string" else F.lit(0)
    return values.get(name, empty).cast(kind).alias(name)


# --- planted scenarios: id base, rows and non-default values of each -----------
# `i` counts rows from 0; AT(x) is the scenario day plus x seconds.
PLANTED_COLUMNS = ["event_id", "ts", "src_ip", "dst_ip", "dst_port", "threat_type",
                   "rule_level", "username", "agent", "country", "action", "policy_id",
                   "proc_image", "decoder"]
_PLANTS = [
    # regular heartbeat, infrastructure cadence, bursty flow
    (200, dict(ts="AT(300*i + (7*i) % 11)", src_ip="'10.9.9.9'", dst_ip="'198.51.100.7'", dst_port="'443'", action="'allowed'")),
    (100, dict(ts="AT(60*i)", src_ip="'10.9.9.10'", dst_ip="'10.0.0.53'", dst_port="'53'")),
    (60, dict(ts="AT(10*i*i)", src_ip="'10.9.9.11'", dst_ip="'198.51.100.8'", dst_port="'443'")),
    # account takeover; a few typing errors
    (1, dict(ts="AT(-54000)", src_ip="'203.0.113.65'", threat_type="'login_success'", username="'ato.victim'", country="'India'")),
    (25, dict(ts="AT(36000 + 60*i)", src_ip="'203.0.113.66'", threat_type="'brute_force'", username="'ato.victim'", country="'Russia'")),
    (1, dict(ts="AT(37560)", src_ip="'203.0.113.66'", threat_type="'login_success'", username="'ato.victim'", country="'Russia'")),
    (4, dict(ts="AT(40000 + 5*i)", src_ip="'203.0.113.70'", threat_type="'brute_force'", username="'typo.user'", country="'India'")),
    (1, dict(ts="AT(40030)", src_ip="'203.0.113.70'", threat_type="'login_success'", username="'typo.user'", country="'India'")),
    # fast and slow travel, one account in three places at once, cluster edge
    (2, dict(ts="AT(3600 + 3600*i)", src_ip="'203.0.113.80'", threat_type="'login_success'", username="'traveler.fast'", country="case when i = 0 then 'India' else 'United States' end")),
    (2, dict(ts="AT(172800*(i-1))", src_ip="'203.0.113.81'", threat_type="'login_success'", username="'traveler.slow'", country="case when i = 0 then 'India' else 'United States' end")),
    (3, dict(ts="AT(10800 + i*(i+1)/2)", src_ip="'203.0.113.82'", threat_type="'login_success'", username="'shared.account'", country="case when i = 0 then 'Germany' when i = 1 then 'Brazil' else 'Japan' end")),
    (3, dict(ts="AT(14400 + 4*i)", src_ip="'203.0.113.83'", threat_type="'login_success'", username="'edge.account'", country="case when i = 0 then 'Germany' when i = 1 then 'Brazil' else 'Japan' end")),
    # silent agent; novelty
    (121, dict(ts="AT(3600*i - 864000)", src_ip="'10.9.9.20'", agent="'host-silent'")),
    (3, dict(ts="AT(18000 + 60*i)", src_ip="'10.9.9.21'", agent="'host-new'", username="'new.user'", proc_image="'/tools/rare'")),
    # policy surge and policy gone quiet
    (36, dict(ts="AT(14400*i - 518400)", src_ip="'10.9.9.22'", policy_id="'PS'", decoder="'fortigate-firewall'", country="'India'")),
    (90, dict(ts="AT(600*i)", src_ip="'10.9.9.22'", policy_id="'PS'", decoder="'fortigate-firewall'", country="case when i = 0 then 'Iran' else 'India' end")),
    (150, dict(ts="AT(3456*i - 518400)", src_ip="'10.9.9.23'", policy_id="'PQ'", decoder="'fortigate-firewall'")),
    # campaign of three addresses
    (9, dict(ts="AT(20000 + 30*i)", src_ip="concat('198.18.5.', cast(i % 3 + 1 as varchar(9)))", threat_type="case when i < 3 then 'recon_scan' when i < 6 then 'ssh_bruteforce' else 'rdp_relay' end", rule_level="12")),
    # new behaviour of a known address
    (40, dict(ts="AT(8640*i - 1728000)", src_ip="'10.8.8.8'", dst_ip="'10.0.0.5'", dst_port="'443'", threat_type="'web_attack'", country="case when i % 2 = 0 then 'India' else 'Germany' end", rule_level="4")),
    (1, dict(ts="AT(21600)", src_ip="'10.8.8.8'", dst_ip="'10.7.7.7'", dst_port="'3389'", threat_type="'privilege_escalation'", country="'India'", rule_level="12")),
    # automated tool; outside address reaching inside; first success after failures
    (10, dict(ts="AT(8640*i - 864000)", src_ip="'192.0.2.10'")),
    (30, dict(ts="AT(30000 + i/5.0)", src_ip="'192.0.2.10'")),
    (12, dict(ts="AT(8640*i - 864000)", src_ip="'198.51.100.20'", dst_ip="'198.51.100.99'")),
    (1, dict(ts="AT(31000)", src_ip="'198.51.100.20'", dst_ip="'10.0.0.9'")),
    (12, dict(ts="AT(8640*i - 864000)", src_ip="'192.0.2.11'", threat_type="case when i < 6 then 'brute_force' else 'recon_scan' end")),
    (1, dict(ts="AT(32000)", src_ip="'192.0.2.11'", threat_type="'login_success'")),
]
_DEFAULTS = dict(dst_ip="''", dst_port="''", threat_type="'unknown'", rule_level="1", username="''",
                 agent="''", country="''", action="''", policy_id="''", proc_image="''", decoder="'json'")


def planted_sql(add_seconds: str) -> str:
    """The planted rows as portable SQL; ``add_seconds`` shifts the scenario day
    by ``{}`` seconds in the dialect at hand."""
    parts = []
    for n, (rows, values) in enumerate(_PLANTS):
        row = {**_DEFAULTS, "event_id": f"cast({10**9 + n * 1000} + i as bigint)", **values}
        inner = row["ts"][3:-1]
        row["ts"] = add_seconds.format(f"({inner})")
        cells = ", ".join(f"{row[c]} as {c}" for c in PLANTED_COLUMNS)
        parts.append(f"select {cells} from range({rows}) as t(i)")
    return " union all ".join(parts)


_PLANTED: dict = {}


def _planted(spark: SparkSession):
    """The fixed planted rows (under a thousand), evaluated once per application,
    so that plans hold one small relation and not one branch per scenario."""
    key = spark.sparkContext.applicationId
    if key not in _PLANTED:
        shift = ("timestampadd(MICROSECOND, cast(round({} * 1e6) as bigint), "
                 "timestamp '2024-01-30 00:00:00')")
        _PLANTED[key] = spark.sql(planted_sql(shift)).toArrow()
    return _PLANTED[key]


def planted_rows(spark: SparkSession) -> DataFrame:
    """The planted scenarios as log rows."""
    in_utc(spark)
    extra = (spark.createDataFrame(_planted(spark))
             .withColumn("severity", C.severity_of_level(F.col("rule_level"))))
    names = set(extra.columns)
    full = extra.select(*[F.col(n).cast(t).alias(n) if n in names else _filled({}, n, t)
                          for n, t in [("event_id", "bigint"), *LOG_FIELDS]])
    return full.withColumn("ingested_at", F.col("ts"))


def planted_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Derived rows plus the planted scenarios."""
    return logs(spark, folder).unionByName(planted_rows(spark))


# --- state logs (several versions per key; ties broken by event_id) ------------

def state_logs(rows: DataFrame) -> dict[str, DataFrame]:
    """State logs of derived log rows that kept ``event_type`` and ``k``."""
    c, lit, when = F.col, F.lit, F.when
    k = c("k")
    tens = F.floor(k / 10)
    return {
        "deviations": rows.select(c("src_ip").alias("ip"), c("event_type").alias("type"), "severity",
                                  c("rule").alias("message"), "ts", "event_id"),
        "blocklist": rows.where(k % 5 == 0).select(
            c("src_ip").alias("ip"), _pick(k % 2, "auto", "manual").alias("kind"),
            (F.floor(k / 5) % 2).cast("int").alias("active"), c("ts").alias("added_at"), "event_id"),
        "ml_scores": rows.select(
            c("src_ip").alias("ip"), k.cast("int").alias("risk_score"),
            ((lit(50) - k) / 100.0).alias("anomaly_score"), (k >= 90).alias("is_anomaly"),
            c("ts").alias("scored_at"), "event_id"),
        "alert_feedback": rows.where(k % 10 == 0).select(
            c("src_ip").alias("entity"), F.concat_ws(":", "threat_type", "rule_id").alias("signature"),
            _pick(tens % 4, "true_positive", "false_positive", "benign", "escalate").alias("disposition"),
            "ts", "event_id"),
        "entity_tags": rows.where(k % 6 == 0).select(
            c("src_ip").alias("entity"), c("event_type").alias("tag"),
            (F.floor(k / 6) % 2).cast("int").alias("active"), c("ts").alias("added_at"), "event_id"),
        "auth_audit": rows.where(c("event_type").isin("signup", "error", "click")).select(
            "username", when(c("event_type") == "signup", "login")
            .when(c("event_type") == "error", "login_failed").otherwise("logout").alias("action"),
            c("src_ip").alias("client_ip"), "ts", "event_id"),
        "playbook_runs": rows.where(c("event_type") == "purchase").select(
            F.concat(lit("R"), (c("event_id") % 200).cast("string")).alias("run_id"),
            F.concat(lit("host:"), c("src_ip")).alias("incident_id"),
            _pick(k % 3, "suggested", "approved", "done").alias("status"),
            c("ts").alias("updated_at"), "event_id"),
    }
