"""Keyed state logs: every change is appended, readers take the newest version."""

from pyspark.sql import DataFrame, functions as F

from ..operators.counts import first_of
from ..schema import STATE_KEYS


def append_state(df: DataFrame, path: str, table: str, stamp=None) -> None:
    """Append versions to a state log; missing version columns get ``stamp``
    (default: now)."""
    _, version = STATE_KEYS[table]
    if version not in df.columns:
        df = df.withColumn(version, F.current_timestamp() if stamp is None else stamp)
    df.write.mode("append").parquet(path)


def latest_by_key(df: DataFrame, keys: list[str], version: str, tiebreak: str | None = None) -> DataFrame:
    """Newest row per key.  A maximum, so partial results merge before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(version, tiebreak) if tiebreak else F.struct(version, *rest)
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def latest(df: DataFrame, table: str, tiebreak: str | None = None) -> DataFrame:
    keys, version = STATE_KEYS[table]
    return latest_by_key(df, keys, version, tiebreak)


def latest_deviations(df, severity=None, ip=None, tiebreak=None) -> DataFrame:
    """Newest alert per (ip, type).  Filters apply before the newest is chosen."""
    if ip is not None:
        df = df.where(F.col("ip") == ip)
    if severity is not None:
        df = df.where(F.col("severity") == severity)
    return latest(df, "deviations", tiebreak)


def newest_alerts(df, limit=None, severity=None, ip=None, tiebreak=None) -> DataFrame:
    return first_of(latest_deviations(df, severity, ip, tiebreak), limit, F.desc("ts"), "ip", "type")


def active_blocks(df, tiebreak=None) -> DataFrame:
    """Blocked now; any kind other than auto counts as manual."""
    now = latest(df, "blocklist", tiebreak).where("active = 1")
    return now.withColumn("kind", F.when(F.col("kind") == "auto", "auto").otherwise("manual"))


def blocked_flags(df, tiebreak=None) -> DataFrame:
    return latest(df, "blocklist", tiebreak).select("ip", (F.col("active") == 1).alias("blocked"))


def active_tags(df, tiebreak=None) -> DataFrame:
    return latest(df, "entity_tags", tiebreak).where("active = 1")


def dispositions(df, tiebreak=None) -> DataFrame:
    """Newest verdict per entity, whatever its signature."""
    named = df.where(F.col("entity") != "")
    return latest_by_key(named, ["entity"], "ts", tiebreak)


def score_list(df, limit=None, anomalies_only=False, tiebreak=None) -> DataFrame:
    now = latest(df, "ml_scores", tiebreak)
    if anomalies_only:
        now = now.where("is_anomaly")
    return first_of(now, limit, F.desc("risk_score"), "ip")


def key_count(df, key: str = "ip") -> DataFrame:
    return df.agg(F.countDistinct(key).alias("keys"))


def run_list(df, incident_id=None, limit=None, tiebreak=None) -> DataFrame:
    now = latest(df, "playbook_runs", tiebreak)
    if incident_id:
        now = now.where(F.col("incident_id") == incident_id)
    return first_of(now, limit, F.desc("updated_at"), "run_id")


def feedback_list(df, limit=None, tiebreak=None) -> DataFrame:
    return first_of(latest(df, "alert_feedback", tiebreak), limit, F.desc("ts"), "entity", "signature")


def new_blocks(active: DataFrame, pushed: DataFrame) -> DataFrame:
    """Blocks not yet handed to the firewall."""
    return active.join(pushed.select("ip").distinct(), "ip", "left_anti")


def feedback_rows(df: DataFrame) -> DataFrame:
    """Incoming verdicts with trimmed texts, the default signature and ``accepted``."""
    from ..functions.fixed import DISPOSITIONS
    t = lambda n: F.trim(F.coalesce(F.col(n), F.lit("")))
    made = F.when((t("threat_type") != "") | (t("rule_id") != ""),
                  F.concat(t("threat_type"), F.lit(":"), t("rule_id"))).otherwise("")
    given = F.coalesce(F.nullif(F.col("signature"), F.lit("")), made)
    out = df.withColumns({"entity": t("entity"), "signature": F.trim(given), "disposition": t("disposition")})
    ok = F.col("disposition").isin(DISPOSITIONS) & ((F.col("entity") != "") | (F.col("signature") != ""))
    return out.withColumn("accepted", ok)


def audit_list(df, limit=None, username="", action="") -> DataFrame:
    if username:
        df = df.where(F.col("username") == username)
    if action:
        df = df.where(F.col("action") == action)
    return first_of(df, limit, F.desc("ts"), "event_id" if "event_id" in df.columns else "username")


def audit_summary(df) -> DataFrame:
    """Logins, failures, first and last login per user (null when never in)."""
    login = F.when(F.col("action") == "login", F.col("ts"))
    return df.groupBy("username").agg(
        F.count_if(F.col("action") == "login").alias("logins"),
        F.count_if(F.col("action") == "login_failed").alias("failures"),
        F.max(login).alias("last_login"), F.min(login).alias("first_login"))
