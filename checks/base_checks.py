"""The derived tables themselves: row-by-row equality on both engines."""

from wardlight.plans import sample_logs as S

from .registry import check, ts

_COLS = ("event_id, src_ip, dst_ip, dst_port, threat_type, severity, rule, rule_id, rule_level, action, country, "
         "agent, mitre, username, mitre_tactic, target_user, rule_groups, proc_image, sc_path, logon_type, decoder, "
         "policy_id, full_log, raw, geo_lat, geo_lon")


@check("derived_logs", f"SELECT {_COLS}, {ts('ts')} AS ts FROM logs")
def _(t):
    return S.logs(t.spark, t.folder).select(*_COLS.split(", "), "ts")


@check("derived_planted_logs", f"""SELECT event_id, {ts('ts')} AS ts, src_ip, dst_ip, dst_port, threat_type, severity,
 username, agent, country, policy_id FROM plogs""")
def _(t):
    return S.planted_logs(t.spark, t.folder).select("event_id", "ts", "src_ip", "dst_ip", "dst_port", "threat_type", "severity",
                          "username", "agent", "country", "policy_id")
