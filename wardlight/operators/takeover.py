"""Account takeover: a success after a burst of failures, or from a new country."""

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed as X

c = F.col
BURST = 5
WINDOW_SECONDS = 3600
_HOUR = 3_600_000_000


def failures_before(events, tie="event_id") -> DataFrame:
    """Successes with the failures of the same user and address in the hour before.

    Failures are counted per instant first.  Every count is placed in its own and the
    next hour slice, so a slice holds all that its successes look back on, and a busy
    pair is spread over slices."""
    at = F.unix_micros("ts")
    hour = F.floor(at / _HOUR)
    failed = c("threat_type").isin(X.FAILURE_TYPES) & (c("src_ip") != "")
    lost = (events.where(failed).groupBy("username", "src_ip", "ts").agg(F.count(F.lit(1)).alias("lost"))
            .select("username", "src_ip", "ts", "lost", F.explode(F.array(hour, hour + 1)).alias("_slice")))
    won = events.where(~failed & (c("threat_type") == "login_success")).select(
        "username", "src_ip", "ts", tie, F.trim("country").alias("country"), hour.alias("_slice"))
    placed = won.unionByName(lost, allowMissingColumns=True).withColumn("_at", at)
    back = (W.partitionBy("username", "src_ip", "_slice").orderBy("_at")
            .rangeBetween(-WINDOW_SECONDS * 1_000_000, 0))
    count = F.sum(F.coalesce("lost", F.lit(0))).over(back)
    return (placed.withColumn("failures", count).where("lost is null")
            .select("username", "src_ip", "ts", tie, "country", "failures"))


def first_countries(events, tie="event_id") -> DataFrame:
    """First success of each user per country, with its position among them."""
    wins = events.where((c("threat_type") == "login_success") & (F.trim("country") != ""))
    first = wins.groupBy("username", F.trim("country").alias("country")).agg(
        F.min(F.struct("ts", tie)).alias("at"))
    spot = F.row_number().over(W.partitionBy("username").orderBy("at"))
    return first.withColumn("position", spot)


def account_takeovers(events, tie="event_id") -> DataFrame:
    """Findings over login events of all users."""
    counted = failures_before(events, tie)
    firsts = first_countries(events, tie)
    fresh = firsts.where("position > 1").select(
        "username", "country", c("at.ts").alias("ts"), c(f"at.{tie}").alias(tie), F.lit(True).alias("new_country"))
    burst = c("failures") >= BURST
    found = (counted.join(fresh, ["username", "country", "ts", tie], "left")
             .withColumn("new_country", F.coalesce("new_country", F.lit(False)))
             .where(burst | c("new_country"))
             .withColumn("severity", F.when(burst & c("new_country"), "critical").otherwise("high")))
    # an account's countries are few, so they go along in one row and the findings are made once
    known = firsts.groupBy("username").agg(F.collect_list(F.struct("at", "country")).alias("_known"))
    before = F.filter("_known", lambda x: x["at"] < F.struct("ts", tie))
    usual = F.when(c("ts").isNotNull() & c(tie).isNotNull(), F.array_sort(F.transform(before, lambda x: x["country"])))
    return (found.join(known, "username", "left")
            .withColumn("usual_countries", F.coalesce(usual, F.array().cast("array<string>"))).drop("_known"))
