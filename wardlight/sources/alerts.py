"""Nested alert JSON lines to log rows: one select over the parsed text."""

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..functions import columns as C
from ..schema import LOG_FIELDS

# column -> (candidate paths in order, longest text kept where texts are cut)
PATHS = {
    "src_ip": (["data.srcip", "data.src_ip", "srcip", "data.win.eventdata.ipAddress", "agent.ip"], None),
    "dst_ip": (["data.dstip", "data.dest_ip", "data.win.eventdata.destinationIp"], None),
    "dst_port": (["data.dstport", "data.dest_port", "data.win.eventdata.destinationPort"], None),
    "rule": (["rule.description"], 200),
    "rule_id": (["rule.id"], None),
    "action": (["data.action"], None),
    "country": (["data.srccountry", "GeoLocation.country_name"], None),
    "agent": (["agent.name"], None),
    "mitre": (["rule.mitre.id"], None),
    "username": (["data.user", "data.win.eventdata.user", "data.win.eventdata.targetUserName",
                  "data.win.eventdata.subjectUserName", "data.dstuser", "data.srcuser",
                  "data.audit.auid", "data.aws.userIdentity.userName",
                  "data.gcp.protoPayload.authenticationInfo.principalEmail",
                  "data.office365.UserId", "syscheck.uname_after"], None),
    "useragent": (["data.http.http_user_agent"], None),
    "signature": (["data.alert.signature"], 200),
    "url": (["data.url", "data.hostname", "data.dstname", "data.uri",
             "data.win.eventdata.queryName", "data.dns.question.name"], 512),
    "mitre_tactic": (["rule.mitre.tactic"], None),
    "mitre_technique": (["rule.mitre.technique"], None),
    "rule_groups": (["rule.groups"], None),
    "pci_dss": (["rule.pci_dss"], None),
    "gdpr": (["rule.gdpr"], None),
    "hipaa": (["rule.hipaa"], None),
    "nist": (["rule.nist_800_53"], None),
    "proc_image": (["data.win.eventdata.image", "data.process.name", "data.command"], 300),
    "proc_parent": (["data.win.eventdata.parentImage", "data.parent.name"], 300),
    "proc_cmdline": (["data.win.eventdata.commandLine", "data.win.eventdata.parentCommandLine"], 500),
    "logon_type": (["data.win.eventdata.logonType"], None),
    "target_user": (["data.win.eventdata.targetUserName", "data.dstuser"], None),
    "sc_path": (["syscheck.path"], None),
    "sc_event": (["syscheck.event"], None),
    "sc_sha256": (["syscheck.sha256_after", "syscheck.sha256_before"], None),
    "decoder": (["decoder.name"], None),
    "location": (["location"], 300),
    "full_log": (["full_log"], 2000),
    "policy_id": (["data.policyid", "data.policy_id"], None),
}
TIME_PATHS = ["@timestamp", "timestamp"]


EXTRA_PATHS = ["rule.level", "rule.firedtimes", "GeoLocation.location.lat", "GeoLocation.location.lon",
               "data.gps_location.lat", "data.gps_location.lon", "id"]


def alert_schema() -> T.StructType:
    """Nested structure of the paths above.  Every leaf is a variant, which keeps whether
    it came as text, number, list or object."""
    tree: dict = {}
    for path in [*[p for paths, _ in PATHS.values() for p in paths], *TIME_PATHS, *EXTRA_PATHS]:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
    made = lambda sub: T.StructType([T.StructField(n, made(s) if s else T.VariantType()) for n, s in sub.items()])
    return made(tree)


def leaf(alert: Column, path: str) -> Column:
    for part in path.split("."):
        alert = alert.getField(part)
    return alert


def field(alert: Column, path: str) -> Column:
    """Text at a dotted path: scalars as they are, lists joined with ', '; an object
    has no text of its own.  The value's own type decides, not how its text begins."""
    value = leaf(alert, path)
    items = F.try_variant_get(value, "$", "array<variant>")
    one = lambda x: F.when(~F.is_variant_null(x), F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x)))
    return (F.when(items.isNotNull(), F.array_join(F.transform(items, one), ", ", "None"))
            .when(F.try_variant_get(value, "$", "map<string,variant>").isNull(), F.try_variant_get(value, "$", "string")))


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their JSON parsed once; blank lines are left out, and broken ones
    have no fields.  Going through a one-element explode keeps later filters on
    parsed fields above the parse, where the optimizer would otherwise repeat it."""
    alert = F.from_json("value", alert_schema())
    return lines.where(F.trim("value") != "").select("value", F.explode(F.array(alert)).alias("alert"))


def alert_level(alert: Column) -> Column:
    return C.whole(field(alert, "rule.level"))


def kept_levels(level: Column, key: Column, min_level=4, sample_below=7, one_in=10) -> Column:
    """Drop low levels, keep one in N of the next ones (by key, so a replay keeps
    the same rows), keep the rest."""
    return (level >= sample_below) | ((level >= min_level) & (F.pmod(key, F.lit(one_in)) == 0))


def to_log_rows(lines: DataFrame, received: Column | None = None, min_level=None,
                sample_below=7, one_in=10, cut: bool = False) -> DataFrame:
    """The 41-column row of every alert that names a source address.  Texts stay whole;
    with ``cut`` they are cut to the lengths of ``PATHS``, and a policy id that only the
    whole log line holds is taken from it first."""
    received = F.current_timestamp() if received is None else received
    alerts = parsed(lines).withColumn("level", alert_level(F.col("alert")))
    if min_level is not None:
        alerts = alerts.where(kept_levels(F.col("level"), F.xxhash64("value"), min_level,
                                          sample_below, one_in))
    v = F.col("alert")
    text = lambda paths: C.first_filled(*[field(v, p) for p in paths])
    number = lambda paths: F.coalesce(text(paths).try_cast("double"), F.lit(0.0))
    # first the texts, each built once; then what is judged from them
    cells = {name: F.substring(text(paths), 1, longest) if cut and longest else text(paths)
             for name, (paths, longest) in PATHS.items()}
    if cut:
        cells["policy_id"] = C.policy_before_cut(cells["policy_id"], text(["full_log"]), PATHS["full_log"][1])
    words = C._joined(text(["rule.groups"]), text(["rule.description"]), text(["rule.pci_dss"]))
    texts = alerts.select(
        "value", "level", *[cell.alias(name) for name, cell in cells.items()], words.alias("_words"),
        text(TIME_PATHS).alias("_time"), text(["rule.firedtimes"]).alias("_fired"),
        number(["GeoLocation.location.lat", "data.gps_location.lat"]).alias("geo_lat"),
        number(["GeoLocation.location.lon", "data.gps_location.lon"]).alias("geo_lon")).where("src_ip != ''")
    judged = {
        "ts": C.event_time(F.col("_time"), received),
        "ingested_at": received,
        "threat_type": C.threat_of_words(F.col("_words")),
        "severity": C.severity_of_level(F.col("level")),
        "rule_level": F.greatest(F.lit(0), F.least(F.lit(255), F.col("level"))),
        "rule_firedtimes": C.whole(F.col("_fired")),
        "raw": F.col("value"),
    }
    return texts.select(*[judged.get(n, F.col(n)).cast(t).alias(n) for n, t in LOG_FIELDS])


def read_alerts(spark: SparkSession, path: str, **options) -> DataFrame:
    """Whole history of an alert folder."""
    return to_log_rows(spark.read.text(path), **options)


def stream_alerts(spark: SparkSession, path: str, max_files: int = 100, **options) -> DataFrame:
    """New alert files as they arrive; the checkpoint remembers what was read."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
    return to_log_rows(lines, **options)


def capped_per_minute(df: DataFrame, cap: int, order: list[str]) -> DataFrame:
    """First ``cap`` rows of each minute (0: no cap).  The limit is applied in
    every task before the shuffle."""
    if cap <= 0:
        return df
    spot = F.row_number().over(W.partitionBy("_minute").orderBy(*order))
    return (df.withColumn("_minute", F.date_trunc("minute", "ts")).withColumn("_spot", spot)
            .where(F.col("_spot") <= cap).drop("_minute", "_spot"))
