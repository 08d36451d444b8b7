"""Pairs of Spark queries and DuckDB SQL over the same tables.

A query is a function of a :class:`Tables` object.  SQL texts name the derived
tables (``logs``, ``plogs``, ``deviations``, …); their definitions are put in
front as common table expressions.
"""

import re
from functools import cached_property

from pyspark.sql import DataFrame, functions as F, types as T

from wardlight.operators.baseline import build_baselines, read_baselines, write_baselines
from wardlight.plans import sample_logs as S
from wardlight.session import shared_folder
from wardlight.sources import rollup_store
from wardlight.sources.store import read_logs, write_logs

AS_OF = S.AS_OF
NOW = f"TIMESTAMP '{AS_OF}'"


_STORES: dict = {}


def stored(spark, folder, name, write):
    """Path of a table of the folder, written by ``write(path)`` once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORES:
        path = f"{shared_folder(spark)}/{name}"
        write(path)
        _STORES[key] = path
    return _STORES[key]


def _log_store(spark, folder):
    """Log store of a folder's derived rows, written once per application in the
    library's own layout, so that queries read what they read in production."""
    return stored(spark, folder, "logs", lambda path: write_logs(S.logs(spark, folder, keep=("event_type", "k")), path))


class Tables:
    """Derived tables of one scale-factor folder."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    @cached_property
    def _rows(self):
        return read_logs(self.spark, _log_store(self.spark, self.folder))

    @cached_property
    def logs(self):
        return self._rows.drop("event_type", "k")

    @cached_property
    def plogs(self):
        return self.logs.unionByName(S.planted_rows(self.spark).withColumn("day", F.to_date("ts")))

    @cached_property
    def baselines(self):
        """Stored baselines of all rows before the last day, as a scan reads them."""
        write = lambda path: write_baselines(build_baselines(self.plogs, AS_OF), path)
        return read_baselines(self.spark, stored(self.spark, self.folder, "baselines", write))

    def rollup(self, table):
        """A stored rollup of the log rows, kept by the library's own refresh."""
        logs = _log_store(self.spark, self.folder)
        path = stored(self.spark, self.folder, "rollups", lambda path: rollup_store.refresh(self.spark, logs, path))
        return rollup_store.read(self.spark, logs, path, table)

    @cached_property
    def events(self):
        return S.base_events(self.spark, self.folder)

    @cached_property
    def state(self):
        return S.state_logs(self._rows)

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


QUERIES, ORACLES = {}, {}


def check(key, sql=None):
    """Register a query (and, where SQL can say it, its oracle)."""
    def add(fn):
        assert key not in QUERIES, key

        def run(spark, folder):
            S.in_utc(spark)
            return plain(fn(Tables(spark, folder)))
        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_tables(sql)
        return fn
    return add


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text, so that engines compare alike."""
    def cell(f):
        if isinstance(f.dataType, T.TimestampType):
            return F.date_format(f.name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name)
        if isinstance(f.dataType, T.DateType):
            return F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        return F.col(f"`{f.name}`")
    return df.select(*[cell(f) for f in df.schema.fields])


def ts(expr):
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def day(expr):
    return f"strftime({expr}, '%Y-%m-%d')"


def n(cond):
    """Conditional count."""
    return f"count(*) FILTER (WHERE {cond})"


_LEVEL = "(event_id*7+k) % 16"
_THREAT = """CASE WHEN event_type='error' THEN ['ssh_bruteforce','brute_force','vpn_bruteforce','rdp_relay'][k%4+1]
 WHEN event_type='signup' THEN 'login_success' WHEN event_type='click' THEN ['web_attack','recon_scan'][k%2+1]
 WHEN event_type='purchase' THEN ['db_scan','privilege_escalation','known_malicious'][k%3+1]
 WHEN k%3=0 THEN 'malware' ELSE 'unknown' END"""
SEV = lambda c: f"CASE WHEN {c}>=12 THEN 'critical' WHEN {c}>=8 THEN 'high' WHEN {c}>=4 THEN 'medium' ELSE 'low' END"
_X = "CAST(user_id % 250 + 1 AS VARCHAR)"

TABLES = {
    "ev": "SELECT event_id, ts, user_id, event_type, CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT) AS k FROM events",
    "logs": f"""SELECT event_id, ts, ts AS ingested_at,
 CASE WHEN user_id%25=0 THEN '85.11.187.'||{_X} WHEN user_id%25=1 THEN '185.220.101.'||{_X}
  WHEN user_id%5=0 THEN '203.0.113.'||{_X} ELSE '10.'||(user_id%4)||'.'||(user_id%7)||'.'||{_X} END AS src_ip,
 '10.'||(event_id%4)||'.0.'||(k%20+1) AS dst_ip,
 ['22','3389','443','53','3306','5432','8080','445','123',''][k%10+1] AS dst_port,
 {_THREAT} AS threat_type, {SEV(_LEVEL)} AS severity,
 'Rule '||({_LEVEL})||': '||({_THREAT}) AS rule, CAST(80000+k AS VARCHAR) AS rule_id,
 CAST({_LEVEL} AS BIGINT) AS rule_level, ['allowed','blocked','denied',''][k%4+1] AS action,
 ['India','Russia','China','United States','Germany',''][(user_id + CASE WHEN k<3 THEN k+1 ELSE 0 END)%6+1] AS country,
 'host-'||(user_id%30) AS agent,
 CASE WHEN event_type='error' THEN 'T1110.001' WHEN event_type='click' THEN ['T1190','T1046'][k%2+1]
  WHEN event_type='purchase' THEN CASE WHEN k%3=1 THEN 'T1068' ELSE 'T1071, T1041' END ELSE '' END AS mitre,
 CASE WHEN user_id%20=0 THEN 'HOST'||user_id||'$' ELSE 'user'||user_id END AS username,
 '' AS useragent, '' AS signature, '' AS url,
 CASE WHEN event_type='error' THEN 'Credential Access' WHEN event_type='purchase' THEN
  CASE WHEN k%3=1 THEN 'Privilege Escalation' ELSE 'Command and Control' END
  WHEN event_type='click' AND k%2=0 THEN 'Initial Access' ELSE '' END AS mitre_tactic,
 '' AS mitre_technique,
 CASE event_type WHEN 'error' THEN 'authentication_failed,sshd' WHEN 'signup' THEN 'authentication_success'
  WHEN 'click' THEN 'web,attack' WHEN 'purchase' THEN 'firewall' ELSE 'syscheck' END AS rule_groups,
 0::BIGINT AS rule_firedtimes, '' AS pci_dss, '' AS gdpr, '' AS hipaa, '' AS nist,
 CASE WHEN k%8=0 THEN '/bin/p'||k ELSE '' END AS proc_image, '' AS proc_parent, '' AS proc_cmdline,
 CASE WHEN event_type='signup' THEN '3' ELSE '' END AS logon_type,
 CASE WHEN k%10=0 THEN 'user'||((user_id+1)%150) ELSE '' END AS target_user,
 CASE WHEN event_type='view' AND k%2=0 THEN '/etc/f'||k ELSE '' END AS sc_path,
 '' AS sc_event, '' AS sc_sha256,
 CASE WHEN k%7=0 THEN (k-50)::DOUBLE ELSE 0.0::DOUBLE END AS geo_lat,
 CASE WHEN k%7=0 THEN (event_id%360-180)::DOUBLE ELSE 0.0::DOUBLE END AS geo_lon,
 CASE WHEN event_type='purchase' THEN 'fortigate-firewall' ELSE 'json' END AS decoder,
 '' AS location, 'date=x policyid='||(k%12) AS full_log,
 '{{"id":"'||event_id||'","data":{{"policyid":"P'||(k%12)||'","url":"h'||(k%9)||'.example.com"}}}}' AS raw,
 CASE WHEN event_type='purchase' AND k%5<>0 THEN 'P'||(k%12) ELSE '' END AS policy_id,
 event_type, k FROM ev""",
    "planted": S.planted_sql("(TIMESTAMP '2024-01-30 00:00:00' + to_microseconds(CAST(round({} * 1e6) AS BIGINT)))"),
    "plogs": f"""SELECT event_id, ts, src_ip, dst_ip, dst_port, threat_type, severity, rule, rule_id, rule_level,
 action, country, agent, mitre, username, mitre_tactic, mitre_technique, rule_groups, proc_image, proc_cmdline,
 logon_type, target_user, sc_path, geo_lat, geo_lon, decoder, location, full_log, raw, policy_id FROM logs
 UNION ALL SELECT event_id, ts, src_ip, dst_ip, dst_port, threat_type, {SEV('rule_level')}, '', '', rule_level::BIGINT,
 action, country, agent, '', username, '', '', '', proc_image, '', '', '', '', 0, 0, decoder, '', '', '', policy_id
 FROM planted""",
    "deviations": "SELECT src_ip AS ip, event_type AS type, severity, rule AS message, ts, event_id FROM logs",
    "blocklist": """SELECT src_ip AS ip, ['auto','manual'][k%2+1] AS kind, (k//5)%2 AS active, ts AS added_at,
 event_id FROM logs WHERE k%5=0""",
    "ml_scores": """SELECT src_ip AS ip, k AS risk_score, (50-k)/100.0::DOUBLE AS anomaly_score, k>=90 AS is_anomaly,
 ts AS scored_at, event_id FROM logs""",
    "alert_feedback": """SELECT src_ip AS entity, threat_type||':'||rule_id AS signature,
 ['true_positive','false_positive','benign','escalate'][(k//10)%4+1] AS disposition, ts, event_id FROM logs WHERE k%10=0""",
    "entity_tags": """SELECT src_ip AS entity, event_type AS tag, (k//6)%2 AS active, ts AS added_at, event_id
 FROM logs WHERE k%6=0""",
    "auth_audit": """SELECT username, CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN 'login_failed'
 ELSE 'logout' END AS action, src_ip AS client_ip, ts, event_id FROM logs WHERE event_type IN ('signup','error','click')""",
    "playbook_runs": """SELECT 'R'||(event_id%200) AS run_id, 'host:'||src_ip AS incident_id,
 ['suggested','approved','done'][k%3+1] AS status, ts AS updated_at, event_id FROM logs WHERE event_type='purchase'""",
    "agg_ip_daily": """SELECT CAST(ts AS DATE) AS day, src_ip, threat_type, severity, count(*) AS events
 FROM logs GROUP BY ALL""",
    "agg_threat_hourly": """SELECT date_trunc('hour', ts) AS hour, threat_type, severity, count(*) AS events
 FROM logs GROUP BY ALL""",
}


def define(name, sql):
    """Add a shared derived table for later SQL texts."""
    TABLES[name] = sql


def with_tables(sql):
    needed, seen = [], set()

    def visit(text):
        for name in TABLES:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                visit(TABLES[name])
                needed.append(name)
    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({TABLES[name]})" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
