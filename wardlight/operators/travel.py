"""Impossible travel: one account in two places too far apart for the time."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as C
from ..functions.times import seconds
from ..session import checkpointed
from .sequence import PARTED, parted, top_per, with_latest_mark, with_previous

c = F.col
SAME_SECONDS = 5.0
LEAST_KM = 400.0
FASTEST_KMH = 900.0
_MICROS = int(SAME_SECONDS * 1_000_000)


def placed_events(events, tie="event_id") -> DataFrame:
    """Events that can be placed on the map."""
    place = C.place_of(c("geo_lat"), c("geo_lon"), c("country"))
    return (events.select("username", "src_ip", "ts", c(tie).alias("event_id"),
                          F.trim("country").alias("country"), place.alias("p"))
            .where("p is not null")
            .select("username", "src_ip", "ts", "event_id", "country", c("p.lat").alias("lat"),
                    c("p.lon").alias("lon")))


def sessions(placed) -> DataFrame:
    """Marks runs of events whose neighbours are at most five seconds apart.  An
    event after a longer pause always opens a new cluster, so clusters can be
    found run by run."""
    return parted_sessions(placed).drop(*PARTED)


def parted_sessions(placed) -> DataFrame:
    """As :func:`sessions`, with the part of its account that an event is in."""
    order = ["ts", "event_id"]
    near = with_previous(parted(placed, ["username"], order), ["username"], order, ["ts"])
    opens = c("prev").isNull() | (F.unix_micros("ts") - F.unix_micros("prev.ts") > _MICROS)
    marked = near.withColumn("session", F.when(opens, c("ts"))).drop("prev")
    return with_latest_mark(marked, ["username"], order, "session")


def _anchors(points) -> DataFrame:
    """Cluster starts of runs of any length, without holding a run in one task.

    From any time the next start is the first later time past the window; inside a
    run it is at most two windows away, so it is found with hourly slices that
    borrow the next seconds.  Following these links from the run's start by
    doubling (1, 2, 4, … steps per round) needs only logarithmically many joins."""
    spark = points.sparkSession
    hour = 3_600_000_000
    at = (points.select("username", "session", F.unix_micros("ts").alias("at")).distinct())
    slot = F.floor(c("at") / hour)
    borrowed = c("at") % hour <= 2 * _MICROS
    spread = at.withColumn("slot", F.explode(F.when(borrowed, F.array(slot, slot - 1)).otherwise(F.array(slot))))
    ahead = (W.partitionBy("username", "session", "slot").orderBy("at")
             .rangeBetween(_MICROS + 1, 2 * _MICROS))
    link = (spread.withColumn("next", F.min("at").over(ahead)).where(c("slot") == slot)
            .where("next is not null").select("username", "session", "at", "next"))
    link = checkpointed(spark, link)
    keys = ["username", "session", "at"]
    found = at.where(c("at") == F.unix_micros("session"))
    while True:
        more = (found.join(link, keys).select("username", "session", c("next").alias("at")))
        grown = checkpointed(spark, found.unionByName(more).distinct())
        if grown.count() == found.count():
            break
        found = grown
        hop = link.select("username", "session", c("at").alias("next"), c("next").alias("far"))
        link = checkpointed(spark, link.join(hop, ["username", "session", "next"])
                            .select("username", "session", "at", c("far").alias("next")))
    return found.select("username", "session", F.timestamp_micros("at").alias("anchor"))


def clusters(placed) -> DataFrame:
    """Events with the start of their five-second cluster, for runs that span more
    than one country (others cannot hold a finding)."""
    return clusters_of(checkpointed(placed.sparkSession, sessions(placed)))


def clusters_of(runs) -> DataFrame:
    """As :func:`clusters`, over events already marked with their run."""
    size = runs.groupBy("username", "session").agg(
        F.min("country").alias("a"), F.max("country").alias("b"))
    # a small part of the runs, read in every round of the anchors
    kept = checkpointed(runs.sparkSession, runs.join(size.where("a <> b").select("username", "session"), ["username", "session"]))
    anchors = _anchors(kept)
    # a cluster lasts five seconds at most: each event looks up the anchors of its
    # own and the previous ten-second box
    box = lambda t: F.floor(F.unix_micros(t) / (2 * _MICROS))
    boxes = anchors.select("username", "session", "anchor", F.explode(F.array(box("anchor"), box("anchor") + 1)).alias("box"))
    paired = (kept.withColumn("box", box("ts")).join(boxes, ["username", "session", "box"])
              .where((c("anchor") <= c("ts")) & (F.unix_micros("ts") - F.unix_micros("anchor") <= _MICROS)))
    return paired.drop("box")


def simultaneous(clustered) -> DataFrame:
    """Clusters with far-apart countries; the widest pair of first appearances."""
    body = F.struct("country", "lat", "lon", "src_ip", "ts")
    first = clustered.groupBy("username", "anchor", "country").agg(
        F.min_by(body, F.struct("ts", "event_id")).alias("e"), F.min(F.struct("ts", "event_id")).alias("o"))
    per = (first.groupBy("username", "anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda x: x["e"]).alias("places"))
        .where(F.size("places") >= 2))
    km = lambda a, b: C.haversine_km(a["lat"], a["lon"], b["lat"], b["lon"])
    # one entry per country name, so the in-row pair search is small
    widest = F.array_max(F.flatten(F.transform(
        "places", lambda a, i: F.transform(
            F.slice(c("places"), i + 2, F.size("places")),
            lambda b: F.struct(km(a, b).alias("km"), a.alias("a"), b.alias("b"))))))
    return (per.withColumn("w", widest).where(c("w.km") >= LEAST_KM).select(
        "username", "anchor", c("w.a.ts").alias("ts"),
        F.lit("critical").alias("severity"), c("w.a").alias("origin"), c("w.b").alias("target"),
        F.bround("w.km", 1).alias("distance_km"), F.lit(None).cast("double").alias("hours"),
        F.lit(None).cast("double").alias("speed_kmh"),
        F.array_sort(F.transform("places", lambda p: p["country"])).alias("countries"),
        F.lit(True).alias("same_instant")))


def sequential(placed) -> DataFrame:
    """Hops between countries faster than any flight; the farthest per pair.  Rows that
    have the parts of their accounts already keep them."""
    order = ["ts", "event_id"]
    cut = placed if PARTED[0] in placed.columns else parted(placed, ["username"], order)
    moved = (with_previous(cut, ["username"], order, ["country"])
             .where("prev is null or prev.country <> country").drop("prev"))
    values = ["country", "lat", "lon", "src_ip", "ts"]
    hop = with_previous(moved, ["username"], order, values).where("prev is not null")
    hours = F.greatest(F.lit(0.0), (seconds(c("ts")) - seconds(c("prev.ts"))) / 3600.0)
    km = C.haversine_km(c("prev.lat"), c("prev.lon"), c("lat"), c("lon"))
    fast = (hop.withColumns({"hours": hours, "km": km})
            .where((c("km") >= LEAST_KM) & (c("hours") > 1.0 / 3600.0) & (c("km") / c("hours") > FASTEST_KMH))
            .withColumns({"distance_km": F.bround("km", 1), "one": F.least("prev.country", "country"),
                          "two": F.greatest("prev.country", "country")}))
    best = top_per(fast, ["username", "one", "two"], [F.desc("distance_km"), "ts", "event_id"], 1)
    return best.select(
        "username", F.lit(None).cast("timestamp").alias("anchor"), "ts", F.lit("high").alias("severity"),
        c("prev").alias("origin"), F.struct(*values).alias("target"), "distance_km",
        F.bround("hours", 4).alias("hours"), F.bround(c("km") / c("hours"), 1).alias("speed_kmh"),
        F.array_sort(F.array("one", "two")).alias("countries"), F.lit(False).alias("same_instant"))


def impossible_travel(events, tie="event_id", per_user=None) -> DataFrame:
    """Simultaneous findings, and sequential ones over the events outside them; all of
    them, or a user's ``per_user`` worst."""
    spark = events.sparkSession
    # both are read several times below; the second is only a small part of the first
    runs = checkpointed(spark, parted_sessions(placed_events(events, tie)))
    grouped = checkpointed(spark, clusters_of(runs.drop(*PARTED)))
    at_once = simultaneous(grouped)
    handled = (grouped.join(at_once.select("username", "anchor"), ["username", "anchor"], "left_semi")
               .select("username", "ts", "event_id"))
    rest = runs.drop("session").join(handled, ["username", "ts", "event_id"], "left_anti")
    found = at_once.unionByName(sequential(rest))
    order = [F.when(c("severity") == "critical", 0).otherwise(1), F.desc("distance_km"), "ts"]
    return top_per(found, ["username"], order, per_user).drop("anchor")
