"""Risk: time-decayed ranking, score fusion, resilience."""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C, fixed as X
from ..functions.columns import row_count
from ..functions.times import ago, hour_crossings, moment, since
from ..schema import RISK_COLUMNS

c = F.col
LN2 = 0.6931471805


def entity_risk(logs, dimension="ip", half_life_hours=72, window_days=30, limit=50, as_of=None) -> DataFrame:
    """Entities by severity points that halve every ``half_life_hours``.

    Events of one entity, severity, hour and destination weigh the same, so they
    are counted first and the exponential runs on counts."""
    column = RISK_COLUMNS.get(dimension, "src_ip")
    now = moment(as_of, logs)
    rows = since(logs, ago(now, days=window_days))
    if dimension in ("user", "host"):
        rows = rows.where(c(column) != "")
    cells = rows.groupBy(c(column).alias("entity"), "severity", F.date_trunc("hour", "ts").alias("hour")).agg(
        row_count("n"), F.max("rule_level").alias("level"), F.max("ts").alias("last"))
    decay = F.exp(F.lit(-LN2) * hour_crossings(c("hour"), now) / max(1, half_life_hours))
    points = cells.groupBy("entity").agg(
        F.sum("n").alias("events"), F.round(F.sum(c("n") * C.risk_weight(c("severity")) * decay), 2).alias("points"),
        F.max("level").alias("max_level"), F.sum(F.when(c("severity") == "critical", c("n")).otherwise(0)).alias("critical"),
        F.max("last").alias("last_seen"))
    top = points.orderBy(F.desc("points"), "entity").limit(limit)
    dsts = (rows.join(F.broadcast(top.select("entity")), c(column) == c("entity"), "left_semi")
            .groupBy(c(column).alias("entity")).agg(F.countDistinct("dst_ip").alias("uniq_dsts")))
    return ranked(top).join(dsts, "entity")


def ranked(top) -> DataFrame:
    """Score relative to the hottest entity of an already limited list."""
    top = C.with_one_value(top, "_hottest", top.select(F.max("points")).scalar())
    best = F.when(c("_hottest") > 0, c("_hottest")).otherwise(1.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.rint(c("points") / best * 100))).cast("long")
    return (top.withColumn("score", score).drop("_hottest").withColumn("band", C.band(c("score"), C.ENTITY_BANDS, "low"))
            .withColumn("risk_points", F.bround("points", 1)).drop("points"))


def with_disposition(risk, verdicts) -> DataFrame:
    return risk.join(verdicts.select("entity", "disposition"), "entity", "left")


def fused_risk(features, scores) -> DataFrame:
    """Anomaly, deviation and intelligence points of scored addresses.
    ``scores``: (ip, anomaly_score, is_anomaly)."""
    anomaly = F.greatest(F.lit(0), F.least(F.lit(55), ((F.lit(0.5) - c("anomaly_score")) * 55).cast("int")))
    deviation = F.least(F.lit(40), (c("baseline_alerts") * 3 + c("critical_alerts") * 8).cast("int"))
    intel = F.when(C.has_prefix(c("ip"), X.SCORING_BAD_PREFIXES), 25).otherwise(0)
    total = F.greatest(F.lit(0), F.least(F.lit(100), c("anomaly_points") + c("deviation_points") + c("intel_points")))
    return (features.select("ip", "baseline_alerts", "critical_alerts").join(scores, "ip")
            .withColumns({"anomaly_points": anomaly, "deviation_points": deviation, "intel_points": intel})
            .withColumn("risk_score", F.when(c("is_anomaly"), F.greatest(total, F.lit(50))).otherwise(total))
            .withColumn("band", C.band(c("risk_score"), C.RISK_BANDS, "low"))
            .withColumn("anomaly_score", F.bround("anomaly_score", 4)))


def address_scores(ips, stored, live) -> DataFrame:
    """Stored score first, else the live one, else intelligence points alone."""
    intel = F.when(C.has_prefix(c("ip"), X.SCORING_BAD_PREFIXES), 25)
    both = (ips.join(stored.select("ip", c("risk_score").alias("stored")), "ip", "left")
            .join(live.select("ip", c("risk_score").alias("live")), "ip", "left"))
    source = (F.when(c("stored").isNotNull(), "stored").when(c("live").isNotNull(), "live")
              .when(intel.isNotNull(), "intel_only").otherwise("not_found"))
    return both.select("ip", F.coalesce("stored", "live", intel).alias("risk_score"), source.alias("source"))


def resilience(logs, baselines, scores, blocks, deviations, as_of=None) -> DataFrame:
    """Four components of 25 points each and a grade.  ``scores`` and ``blocks`` are
    newest state."""
    week = ago(moment(as_of, logs), days=7)
    count = lambda df, key: df.agg(F.countDistinct(key).alias("n")).scalar()
    recent = since(logs, week).where(c("ts") > week)
    row = recent.agg(F.countDistinct("src_ip").alias("active_ips"), row_count("events_7d")).withColumns({
        "baselined": count(baselines, "ip"), "scored": count(scores, "ip"),
        "critical": count(scores.where("risk_score >= 70"), "ip"), "blocked": count(blocks, "ip"),
        "flagged_7d": count(deviations.where(c("ts") > week), "ip")})
    pct = lambda part, whole: F.least(F.lit(100.0), F.rint(c(part) / F.greatest(whole, F.lit(1)) * 100)).cast("long")
    quarter = lambda name: F.rint(c(name) * 0.25).cast("long")
    row = row.withColumns({"ml_pct": pct("scored", c("active_ips")), "baseline_pct": pct("baselined", c("active_ips")),
                           "pressure_points": F.greatest(F.lit(0), 25 - c("critical") * 3),
                           "response_pct": pct("blocked", c("critical") + c("flagged_7d"))})
    row = row.withColumns({"ml_points": quarter("ml_pct"), "baseline_points": quarter("baseline_pct"),
                           "response_points": quarter("response_pct"),
                           "pressure_pct": F.rint(c("pressure_points") / 25 * 100).cast("long")})
    total = c("ml_points") + c("baseline_points") + c("pressure_points") + c("response_points")
    return row.withColumn("score", total).withColumn("grade", C.band(total, C.GRADE_BANDS, "F"))
