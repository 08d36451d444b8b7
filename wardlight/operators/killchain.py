"""An address's activity laid out along the attack life cycle."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from .sequence import top_per

c = F.col
KEY = "src_ip"


def cells(logs) -> DataFrame:
    """The one pass over the rows: counts and times per address, tactic, technique
    and severity.  Stages, phases and signals are folded from this small frame."""
    raw = ["threat_type", "mitre", "rule_groups", "mitre_tactic", "mitre_technique"]
    sums = lambda n: [n.alias("events"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")]
    # equal texts are counted first; techniques are looked up once per combination
    combos = (logs.select(KEY, "severity", *raw, c("ts").alias("first_seen"), c("ts").alias("last_seen"))
              .groupBy(KEY, "severity", *raw).agg(*sums(F.count(F.lit(1)))))
    lead = C.lead_technique(c("threat_type"), c("mitre"), c("rule_groups"))
    placed = combos.withColumn("lead", lead)
    return placed.groupBy(
        KEY, C.tactic_of(c("mitre_tactic"), c("lead")).alias("tactic"),
        F.coalesce("lead", "mitre").alias("technique"),
        F.coalesce(C.technique_name(c("lead")), c("mitre_technique")).alias("technique_name"), "severity",
    ).agg(*sums(F.sum("events")))


def _severity_sums():
    return [F.sum(F.when(c("severity") == s, c("events")).otherwise(0)).alias(s) for s in reversed(X.SEVERITIES)]


def stages(cell) -> DataFrame:
    """One row per address and tactic, with the tactic's rank."""
    return (cell.groupBy(KEY, "tactic").agg(
        F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), *_severity_sums())
        .withColumn("rank", C.tactic_rank(c("tactic"))))


def stage_techniques(cell) -> DataFrame:
    """Techniques of each stage with their counts, busiest first."""
    per = (cell.where("technique != ''").groupBy(KEY, "tactic", "technique", "technique_name")
           .agg(F.sum("events").alias("events")))
    spot = F.row_number().over(W.partitionBy(KEY, "tactic").orderBy(F.desc("events"), "technique"))
    return per.withColumn("position", spot)


def chains(stage) -> DataFrame:
    """Progression, deepest stage and whether lateral movement was reached."""
    step = F.struct("rank", "first_seen", "tactic")
    lateral = X.TACTICS.index("Lateral Movement")
    # the deepest stage is the earliest seen among those of the highest rank
    deepest = F.struct("rank", (-F.unix_micros("first_seen")).alias("age"))
    return (stage.groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(step)), lambda s: s["tactic"]).alias("progression"),
        F.max_by("tactic", deepest).alias("max_stage"), F.max("rank").alias("stage_rank"),
        F.sum("events").alias("total_events"), F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"), *[F.sum(s).alias(s) for s in reversed(X.SEVERITIES)])
        .withColumn("reached_lateral", c("stage_rank") >= lateral))


def phases(stage) -> DataFrame:
    """Seven phases of every address, reached or not."""
    seen = (stage.withColumn("phase", C.phase_of(c("tactic"))).where("phase != ''").groupBy(KEY, "phase").agg(
        F.sum("events").alias("events"), F.array_sort(F.collect_set("tactic")).alias("tactics"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")))
    skeleton = stage.select(KEY).distinct().select(
        KEY, F.posexplode(F.array(*map(F.lit, X.PHASES))).alias("num", "phase"))
    return skeleton.join(seen, [KEY, "phase"], "left").select(
        KEY, "phase", (c("num") + 1).alias("num"), c("events").isNotNull().alias("reached"),
        F.coalesce("events", F.lit(0)).alias("events"),
        F.coalesce("tactics", F.array().cast("array<string>")).alias("tactics"), "first_seen", "last_seen")


def firewall_outcome(logs, keep=None) -> DataFrame:
    """Allowed and blocked traffic per address; no action at all means observed.  The
    destinations are all (for display at most ``keep``)."""
    allowed, blocked = C.is_allowed(c("action")), C.is_blocked(c("action"))
    acted = F.trim("action") != ""
    per = logs.groupBy(KEY, "dst_ip").agg(
        row_count("events"), F.count_if(acted).alias("acted"),
        F.count_if(acted & allowed).alias("allowed"), F.count_if(acted & blocked).alias("blocked"))
    listed = []
    for name in ("allowed", "blocked"):
        hit = per.where((c(name) > 0) & (c("dst_ip") != "")).select(KEY, "dst_ip")
        best = top_per(hit, [KEY], ["dst_ip"], keep)
        listed.append(best.groupBy(KEY).agg(F.array_sort(F.collect_list("dst_ip")).alias(f"{name}_ips")))
    status = (F.when(c("acted") == 0, "observed").when((c("blocked") > 0) & (c("allowed") == 0), "blocked")
              .when(c("blocked") > 0, "partial").otherwise("allowed"))
    out = per.groupBy(KEY).agg(*[F.sum(x).alias(x) for x in ("events", "acted", "allowed", "blocked")]) \
        .withColumn("status", status)
    for part in listed:
        out = out.join(part, KEY, "left")
    return out


def blocking_rules(logs, keep=5) -> DataFrame:
    """Rules behind the blocks of each address."""
    rid, text = F.trim("rule_id"), F.trim("rule")
    per = (logs.where(C.is_blocked(c("action")) & ((rid != "") | (text != "")))
           .groupBy(KEY, rid.alias("rule_id"), text.alias("policy"))
           .agg(F.max("rule_level").alias("level"), row_count("events")))
    return top_per(per, [KEY], [F.desc("events"), "rule_id", "policy"], keep)


def path_facts(logs, topology=None) -> DataFrame:
    """Top destination of an address, its segment, topology attributes, and the
    number of destinations, ports and agents."""
    dst = (logs.where("dst_ip != ''").groupBy(KEY, "dst_ip").agg(row_count("hits"))
           .groupBy(KEY).agg(F.count(F.lit(1)).alias("destinations"),
                             F.max_by("dst_ip", F.struct("hits", "dst_ip")).alias("top_dst"),
                             F.max("hits").alias("top_hits")))
    breadth = logs.groupBy(KEY).agg(
        row_count("events"), F.countDistinct(F.nullif("dst_port", F.lit(""))).alias("ports"),
        F.countDistinct(F.nullif("agent", F.lit(""))).alias("agents"),
        F.min(F.nullif("agent", F.lit(""))).alias("first_agent"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    out = breadth.join(dst, KEY, "left").withColumn("segment", C.segment_label(c("top_dst")))
    if topology is not None:
        out = out.join(topology.select(c("ip").alias("top_dst"), c("attrs")), "top_dst", "left")
        attr = lambda *names: F.coalesce(*[c("attrs")[n] for n in names], F.lit(""))
        out = out.withColumns({
            "switch": attr("switch_name", "switch"), "vlan": attr("vlan"), "floor": attr("floor"),
            "department": attr("department", "dept"), "device_type": attr("device_type", "type"),
            "owner": attr("owner", "user", "assigned_to"), "switch_port": attr("switch_port", "port"),
            "hostname": F.coalesce(c("attrs")["hostname"], c("attrs")["device_name"], c("attrs")["name"],
                                   F.when(c("agents") == 1, c("first_agent"))
                                   .otherwise(F.concat(c("agents").cast("string"), F.lit(" hosts"))))})
    return out


def waves(logs) -> DataFrame:
    """Activity per address and hour: events, tactics and worst severity."""
    per = logs.groupBy(KEY, F.date_trunc("hour", "ts").alias("hour")).agg(
        row_count("events"), F.array_sort(F.collect_set(F.nullif("mitre_tactic", F.lit("")))).alias("tactics"),
        F.max(C.severity_rank(c("severity"))).alias("worst"))
    return per.withColumn("peak_severity", C.severity_name(c("worst"))).drop("worst")


def velocity(wave) -> DataFrame:
    """Mean events per active hour and the busiest hour (the earliest on ties)."""
    peak = F.struct("events", (-F.unix_seconds("hour")).alias("age"))
    return wave.groupBy(KEY).agg(
        F.bround(F.sum("events") / F.count(F.lit(1)), 1).alias("avg_per_hour"),
        F.max_by("hour", peak).alias("peak_hour"), F.max("events").alias("peak_count"),
        F.count(F.lit(1)).alias("hours_active"))


def targeted_accounts(logs, keep=10) -> DataFrame:
    per = (logs.groupBy(KEY, "username", "target_user").agg(row_count("hits"))
           .select(KEY, F.explode(F.array(F.trim("username"), F.trim("target_user"))).alias("account"), "hits")
           .where("account != ''").groupBy(KEY, "account").agg(F.sum("hits").alias("hits")))
    return top_per(per, [KEY], [F.desc("hits"), "account"], keep)


def top_rules(logs, keep=8) -> DataFrame:
    """Rules fired, keyed by id or else by their text."""
    text, rid = F.trim("rule"), F.trim("rule_id")
    key = F.coalesce(F.nullif(rid, F.lit("")), text)
    per = (logs.where(text != "").groupBy(KEY, key.alias("rule_key"))
           .agg(row_count("events"), F.min_by(F.struct("rule", "severity"), "ts").alias("first")))
    return top_per(per, [KEY], [F.desc("events"), "rule_key"], keep).select(KEY, "rule_key", "events", "first.*")


def port_sequence(logs, keep=15) -> DataFrame:
    """Ports in order of first use."""
    per = (logs.where("dst_port != ''").groupBy(KEY, c("dst_port").alias("port"))
           .agg(row_count("events"), F.min("ts").alias("first_seen")))
    return (top_per(per, [KEY], ["first_seen", "port"], keep, rank="rank")
            .withColumn("service", C.service_name(c("port"))))


def technique_chain(logs) -> DataFrame:
    """Technique fields in order of first use."""
    first = F.min_by(F.struct(c("mitre_technique").alias("name"), c("mitre_tactic").alias("tactic")), "ts")
    per = (logs.where("mitre != ''").groupBy(KEY, c("mitre").alias("technique"))
           .agg(row_count("events"), F.min("ts").alias("first_seen"), first.alias("f")))
    spot = F.row_number().over(W.partitionBy(KEY).orderBy("first_seen", "technique"))
    return per.select(KEY, "technique", "events", "first_seen", "f.*", spot.alias("position"))


def knowledge(spark) -> DataFrame:
    """The technique dimension (a fixed ten rows)."""
    return spark.createDataFrame(
        [(i, t[0], t[1], t[2], t[4], X.TECHNIQUE_PAGE + t[0] + "/") for i, t in enumerate(X.TECHNIQUES)],
        "position int, technique string, name string, tactic string, mitigations array<string>, reference string")


def attack_coverage(spark, rollup, technique_events) -> DataFrame:
    """Every known technique with the events that point to it, by id or by type."""
    by_type = (rollup.where(~c("threat_type").isin("unknown", "")).groupBy("threat_type")
               .agg(F.sum("events").alias("events"))
               .select(C.threat_technique(c("threat_type")).alias("technique"), "events"))
    volume = (technique_events.select("technique", "events").unionByName(by_type)
              .where("technique is not null").groupBy("technique").agg(F.sum("events").alias("events")))
    out = knowledge(spark).join(volume, "technique", "left")
    return out.select("technique", "name", "tactic", C.tactic_rank(c("tactic")).alias("tactic_rank"),
                      F.coalesce("events", F.lit(0)).alias("events"),
                      (F.coalesce("events", F.lit(0)) > 0).alias("covered"))


def coverage_summary(coverage) -> DataFrame:
    done = F.count_if(c("covered"))
    return coverage.agg(row_count("techniques_total"), done.alias("techniques_covered"),
                        F.rint(done / F.count(F.lit(1)) * 100).cast("long").alias("coverage_pct"))


def grounded_brief(spark, cell, keep=8) -> DataFrame:
    """Known techniques of an address with its first ``keep`` distinct mitigations
    (in kill-chain and technique order) and references."""
    seen = (cell.groupBy(KEY, "tactic", "technique").agg(
        F.sum("events").alias("events"), F.min("first_seen").alias("first_seen"))
        .withColumn("stage_first", F.min("first_seen").over(W.partitionBy(KEY, "tactic")))
        .withColumn("base", C.technique_base(c("technique"))).where("base is not null"))
    order = F.struct(C.tactic_rank(c("tactic")).alias("rank"), c("stage_first"), (-c("events")).alias("minus"))
    first = seen.groupBy(KEY, "base").agg(F.min(order).alias("at"))
    known = first.join(F.broadcast(knowledge(spark)), c("base") == c("technique"))
    steps = (known.select(KEY, "at", F.posexplode("mitigations").alias("i", "mitigation"))
             .groupBy(KEY, "mitigation").agg(F.min(F.struct("at", "i")).alias("place")))
    advice = top_per(steps, [KEY], ["place", "mitigation"], keep).groupBy(KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "mitigation"))),
                    lambda m: m["mitigation"]).alias("mitigations"))
    entry = F.struct("at", "technique", "name", "tactic", "reference")
    listed = known.groupBy(KEY).agg(F.array_sort(F.collect_list(entry)).alias("entries")).select(
        KEY, F.transform("entries", lambda e: e["technique"]).alias("techniques"),
        F.transform("entries", lambda e: e["reference"]).alias("references"))
    return listed.join(advice, KEY, "left")
