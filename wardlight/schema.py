"""Table layouts: the wide log table, its rollups and the keyed state logs."""

from pyspark.sql import types as T

# Absent strings are '' and absent numbers 0, never null.
LOG_FIELDS = [
    ("ts", "timestamp"), ("ingested_at", "timestamp"), ("src_ip", "string"),
    ("dst_ip", "string"), ("dst_port", "string"), ("threat_type", "string"),
    ("severity", "string"), ("rule", "string"), ("rule_id", "string"),
    ("rule_level", "smallint"), ("action", "string"), ("country", "string"),
    ("agent", "string"), ("mitre", "string"), ("username", "string"),
    ("useragent", "string"), ("signature", "string"), ("url", "string"),
    ("mitre_tactic", "string"), ("mitre_technique", "string"), ("rule_groups", "string"),
    ("rule_firedtimes", "bigint"), ("pci_dss", "string"), ("gdpr", "string"),
    ("hipaa", "string"), ("nist", "string"), ("proc_image", "string"),
    ("proc_parent", "string"), ("proc_cmdline", "string"), ("logon_type", "string"),
    ("target_user", "string"), ("sc_path", "string"), ("sc_event", "string"),
    ("sc_sha256", "string"), ("geo_lat", "double"), ("geo_lon", "double"),
    ("decoder", "string"), ("location", "string"), ("full_log", "string"),
    ("raw", "string"), ("policy_id", "string"),
]
_TYPES = {"timestamp": T.TimestampType(), "string": T.StringType(), "smallint": T.ShortType(),
          "bigint": T.LongType(), "double": T.DoubleType()}
LOG_SCHEMA = T.StructType([T.StructField(n, _TYPES[t]) for n, t in LOG_FIELDS])

# state log -> (key columns, version column)
STATE_KEYS = {
    "baselines": (["ip"], "built_at"),
    "deviations": (["ip", "type"], "ts"),
    "blocklist": (["ip"], "added_at"),
    "ml_scores": (["ip"], "scored_at"),
    "playbook_runs": (["run_id"], "updated_at"),
    "cases": (["case_id"], "updated_at"),
    "entity_tags": (["entity", "tag"], "added_at"),
    "alert_feedback": (["entity", "signature"], "ts"),
    "users": (["username"], "created_at"),
}

# Entities a caller may group by.
TRAIL_COLUMNS = {"ip": "src_ip", "username": "username", "host": "agent"}
ENTITY_COLUMNS = {"username": "username", "agent": "agent", "target_user": "target_user"}
RISK_COLUMNS = {"ip": "src_ip", "user": "username", "host": "agent"}


def trail_column(field: str) -> str:
    """Unknown names mean the source address."""
    return TRAIL_COLUMNS.get(field, "src_ip")


def entity_column(field: str) -> str:
    """Unknown names are refused."""
    if field not in ENTITY_COLUMNS:
        raise ValueError(f"unknown entity field {field!r}")
    return ENTITY_COLUMNS[field]
