"""Additive rollups: partial counts that any number of batches may append.

Readers always add up, so partial rows of one key may coexist and late rows land
in their own bucket at any age.
"""

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as C

DAILY_KEYS = ["day", "src_ip", "threat_type", "severity"]
HOURLY_KEYS = ["hour", "threat_type", "severity"]


def daily(logs: DataFrame) -> DataFrame:
    return (logs.groupBy(F.to_date("ts").alias("day"), "src_ip", "threat_type", "severity")
            .agg(F.count(F.lit(1)).alias("events")))


def hourly(logs: DataFrame) -> DataFrame:
    return (logs.groupBy(F.date_trunc("hour", "ts").alias("hour"), "threat_type", "severity")
            .agg(F.count(F.lit(1)).alias("events")))


def summed(partials: DataFrame, keys: list[str]) -> DataFrame:
    return partials.groupBy(*keys).agg(F.sum("events").alias("events"))


#: Sketches hold 2 ** SKETCH_BITS registers.
SKETCH_BITS = 12


def techniques(logs: DataFrame) -> DataFrame:
    """Events per day and technique field; a field may list several ids."""
    return logs.where("mitre != ''").groupBy(F.to_date("ts").alias("day"), "mitre").agg(F.count(F.lit(1)).alias("events"))


def sketches(logs: DataFrame) -> DataFrame:
    """Mergeable sketches of the different source addresses and users per day and threat type."""
    return logs.groupBy(F.to_date("ts").alias("day"), "threat_type").agg(
        F.hll_sketch_agg("src_ip", SKETCH_BITS).alias("ips"), F.hll_sketch_agg(F.nullif("username", F.lit("")), SKETCH_BITS).alias("users"))


def sketched(partials: DataFrame, *keys: str) -> DataFrame:
    """About how many different addresses and users, over any days, by ``keys``."""
    return partials.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("ips")).alias("ips"),
                                       F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"))


def sketch_error(deviations: float = 3.0) -> float:
    """Relative error that an estimate keeps within so many standard deviations."""
    return deviations * 1.04 / 2 ** (SKETCH_BITS / 2)


def first_seen(logs: DataFrame, by: tuple = ()) -> DataFrame:
    """Ledger of new things: six kinds of key from one scan of the rows; ``by``
    columns (the day) give partial ledgers."""
    c = F.col
    user_host = ((c("username") != "") & (c("agent") != "") & ~c("username").endswith("$")
                 & (F.lower("username") != F.lower("agent")))
    kinds = [
        ("user_host", F.when(user_host, F.concat_ws("|", "username", "agent"))),
        ("binary", F.nullif(c("proc_image"), F.lit(""))),
        ("binary_host", F.when((c("proc_image") != "") & (c("agent") != ""),
                               F.concat_ws("|", "proc_image", "agent"))),
        ("agent", F.nullif(c("agent"), F.lit(""))),
        ("country", F.nullif(c("country"), F.lit(""))),
        ("port", F.nullif(c("dst_port"), F.lit(""))),
    ]
    # Equal key sets are counted first, so the six-fold expansion runs on the
    # distinct sets of a task and not on every row.
    keyed = (logs.select("ts", *by, *[key.alias(name) for name, key in kinds])
             .groupBy(*by, *[name for name, _ in kinds])
             .agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("events")))
    pairs = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("key")) for name, _ in kinds])
    return (keyed.select(*by, F.explode(pairs).alias("p"), "first_ts", "events")
            .where("p.key is not null").select(*by, "p.kind", "p.key", "first_ts", "events")
            .groupBy(*by, "kind", "key").agg(F.min("first_ts").alias("first_ts"), F.sum("events").alias("events")))


def merged_first_seen(partials: DataFrame) -> DataFrame:
    return partials.groupBy("kind", "key").agg(F.min("first_ts").alias("first_ts"),
                                               F.sum("events").alias("events"))


def backfill_daily(logs: DataFrame, first_day: str, last_day: str, path: str | None = None) -> DataFrame:
    """Daily rollup of a date range, rebuilt from the rows.  With a path, exactly
    those day partitions are replaced."""
    day = F.to_date("ts")
    rows = logs.where((F.col("ts") >= F.lit(first_day).cast("timestamp"))
                      & (day >= F.lit(first_day).cast("date")) & (day <= F.lit(last_day).cast("date")))
    out = daily(rows)
    if path:
        (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day").parquet(path))
    return out
