"""Flat rows with dotted names (CSV uploads, JSON bodies) to log rows."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import columns as C, fixed as X
from ..schema import LOG_FIELDS

# column -> candidate fields; the first field that exists counts, even if blank
FIRST_PRESENT = {
    "dst_ip": ["data.dstip", "data.dest_ip", "network.destIp", "data.win.eventdata.destinationIp"],
    "dst_port": ["data.dstport", "data.dest_port", "network.destPort", "data.win.eventdata.destinationPort"],
    "rule_id": ["rule.id"], "action": ["data.action"], "country": ["data.srccountry"], "agent": ["agent.name"],
    "mitre": ["rule.mitre.id"], "username": ["data.user", "data.win.eventdata.user"],
    "useragent": ["data.http.http_user_agent"],
}
# column -> (candidate fields, longest text where texts are cut); the first filled field counts
FIRST_FILLED = {
    "mitre_tactic": (["rule.mitre.tactic"], None), "mitre_technique": (["rule.mitre.technique"], None),
    "rule_groups": (["rule.groups"], None), "pci_dss": (["rule.pci_dss"], None), "gdpr": (["rule.gdpr"], None),
    "hipaa": (["rule.hipaa"], None), "nist": (["rule.nist_800_53"], None),
    "proc_image": (["data.win.eventdata.image", "data.process.name", "data.command"], 300),
    "proc_parent": (["data.win.eventdata.parentImage", "data.parent.name"], 300),
    "proc_cmdline": (["data.win.eventdata.commandLine", "data.win.eventdata.parentCommandLine"], 500),
    "logon_type": (["data.win.eventdata.logonType"], None),
    "target_user": (["data.win.eventdata.targetUserName", "data.dstuser"], None),
    "sc_path": (["syscheck.path"], None), "sc_event": (["syscheck.event"], None),
    "sc_sha256": (["syscheck.sha256_after", "syscheck.sha256_before"], None),
    "decoder": (["decoder.name"], None), "location": (["location"], 300), "full_log": (["full_log"], 2000),
}


def read_csv(spark: SparkSession, path) -> DataFrame:
    """All columns as text, blanks for missing cells."""
    return spark.read.option("header", True).csv(path).fillna("")


def read_json_body(spark: SparkSession, path) -> DataFrame:
    """A list of rows, or an object whose ``logs`` is one."""
    body = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    return _unwrapped(body)


def read_json_lines(spark: SparkSession, path, schema=None) -> DataFrame:
    """One object a line; a ``schema`` that is known already saves a pass."""
    return spark.read.option("primitivesAsString", True).option("mode", "DROPMALFORMED").json(path, schema=schema)


def read_dropped(spark: SparkSession, paths: list[str], kind: str) -> DataFrame:
    """Log rows of dropped files of one ``kind`` (csv, json or lines).  Files may differ in their
    columns, so each is read by its own; CSV files and files of lines that have the same columns
    are read together, so the plan grows with different layouts and not with files."""
    if kind == "json":
        parts = [to_log_rows(read_json_body(spark, path)) for path in paths]
    else:
        read = read_csv if kind == "csv" else read_json_lines
        layouts: dict = {}
        for path in paths:
            schema = read(spark, path).schema
            layouts.setdefault(schema.json(), (schema, []))[1].append(path)
        parts = [to_log_rows(read_csv(spark, same) if kind == "csv" else read_json_lines(spark, same, schema))
                 for schema, same in layouts.values()]
    return reduce(DataFrame.unionByName, parts)


def _unwrapped(body: DataFrame) -> DataFrame:
    if "logs" in body.columns:
        return body.select(F.explode("logs").alias("row")).select("row.*")
    return body


def to_log_rows(rows: DataFrame, received=None, cut: bool = False) -> DataFrame:
    """Log row of every flat row that names a source address (``url``, ``policy_id``
    and ``raw`` stay blank on this path).  Texts stay whole; with ``cut`` they are cut to
    fixed lengths, and a policy id that only the whole log line holds is taken from it first."""
    received = F.current_timestamp() if received is None else received
    have = set(rows.columns)
    cells = lambda names: [F.col(f"`{n}`").cast("string") for n in names if n in have] or [F.lit(None).cast("string")]
    present = lambda *names: F.coalesce(*cells(names), F.lit(""))
    filled = lambda names: C.first_filled(*cells(names))
    words = C.flat_text([present(n) for n in X.FLAT_TEXT_FIELDS])
    verdict = C.flat_class(F.col("_words"), present("data.level", "rule.level"))
    level = C.whole(present("rule.level"))
    number = lambda names: F.coalesce(filled(names).try_cast("double"), F.lit(0.0))
    out = {n: present(*names) for n, names in FIRST_PRESENT.items()}
    out |= {n: F.substring(filled(names), 1, most) if cut and most else filled(names)
            for n, (names, most) in FIRST_FILLED.items()}
    out |= {
        "ts": C.event_time(present("@timestamp"), received), "ingested_at": received,
        "src_ip": F.col("_src"), "threat_type": F.col("_class.threat_type"), "severity": F.col("_class.severity"),
        "rule": F.substring(present("rule.description"), 1, 200) if cut else present("rule.description"),
        "signature": F.substring(present("data.alert.signature"), 1, 200) if cut else present("data.alert.signature"),
        "rule_level": F.greatest(F.lit(0), F.least(F.lit(255), level)),
        "rule_firedtimes": C.whole(filled(["rule.firedtimes"])),
        "geo_lat": number(["GeoLocation.location.lat", "data.gps_location.lat"]),
        "geo_lon": number(["GeoLocation.location.lon", "data.gps_location.lon"]),
    }
    if cut:
        out["policy_id"] = C.policy_before_cut(F.lit(""), filled(["full_log"]), FIRST_FILLED["full_log"][1])
    source = C.source_address(rows.columns)
    blank = F.lit("")
    return (rows.withColumns({"_src": source, "_words": words}).where("_src is not null").withColumn("_class", verdict)
            .select(*[out.get(n, blank).cast(t).alias(n) for n, t in LOG_FIELDS]))


def ingest_counts(rows: DataFrame) -> DataFrame:
    """How many rows a body holds, and how many of them can be kept."""
    ok = C.source_address(rows.columns).isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("count"), F.count_if(ok).alias("saved"), F.count_if(~ok).alias("skipped"))
