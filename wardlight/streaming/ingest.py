"""Alert stream to log table and rollups, in whole batches.

One micro-batch writes the log rows and the partial rollups under an attempt of its own
and then a line in a small table of finished attempts.  Readers see the newest finished
attempt of each batch and nothing else: never half a batch, nothing twice, and nothing of an
earlier attempt, also where a retry has no rows any more.  A compaction is an attempt that
stands for all batches up to one; :func:`cleaned` removes what no reader sees.
"""

import time
import uuid
from functools import partial

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import baseline as B, rollups as R
from ..session import in_utc
from ..sources import alerts, flat

c = F.col
TABLES = ("logs", "agg_ip_daily", "agg_threat_hourly", "first_seen", "deviations", "minutes")
FINISHED = "finished"


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table's rows; None while there is no such folder."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def write_attempt(df: DataFrame, root: str, table: str, batch: int, attempt: str, by_day: bool = False) -> None:
    """One attempt's part of a table, which readers see when the attempt is finished."""
    out = df.withColumns({"batch": F.lit(batch).cast("long"), "attempt": F.lit(attempt)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *["attempt", *(["day"] if by_day else [])]).parquet(f"{root}/{table}")


def finish(spark: SparkSession, root: str, batch: int, attempt: str, compacts: bool = False) -> None:
    """From here on readers see the attempt, and no earlier one of the batch; with
    ``compacts``, none of any batch up to this one."""
    line = [(batch, attempt, compacts, time.time_ns())]
    (spark.createDataFrame(line, "batch long, attempt string, compacts boolean, at long").coalesce(1)
     .write.mode("append").parquet(f"{root}/{FINISHED}"))


def visible(spark: SparkSession, root: str) -> DataFrame | None:
    """(batch, attempt) of what readers see: the newest compaction and, of every later batch,
    the newest attempt."""
    lines = _table(spark, f"{root}/{FINISHED}")
    if lines is None:
        return None
    newest = lines.groupBy("batch", "compacts").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt"))
    through = newest.where("compacts").select(F.max("batch")).scalar()
    return newest.where(F.when(c("compacts"), c("batch") == through).otherwise(through.isNull() | (c("batch") > through))).select(
        "batch", "attempt")


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's finished rows.  The join is on a partition column, so parts of other
    attempts are not read."""
    rows, seen = spark.read.parquet(f"{root}/{table}"), visible(spark, root)
    if seen is None:
        return rows.limit(0).drop("attempt")
    return rows.join(F.broadcast(seen.select("attempt")), "attempt", "left_semi").drop("attempt")


def _earlier(spark, root, table, batch):
    """A table's finished rows of batches before this one; None while there are none."""
    if _table(spark, f"{root}/{table}") is None:
        return None
    return read_table(spark, root, table).where(c("batch") < batch).drop("batch")


def store_batch(rows: DataFrame, batch: int, root: str, cap: int = 0) -> None:
    """Everything one micro-batch leaves behind."""
    spark, attempt = in_utc(rows.sparkSession), uuid.uuid4().hex
    rows = rows.persist()
    kept = rows
    try:
        if cap:
            kept, counts = capped(rows, batch, root, cap)
            write_attempt(counts, root, "minutes", batch, attempt)
        spread = F.pmod(F.hash("ts"), F.lit(64))
        logs = (kept.withColumn("day", F.to_date("ts")).repartition("day", "src_ip", spread)
                .sortWithinPartitions("day", "src_ip", "ts"))
        write_attempt(logs, root, "logs", batch, attempt, by_day=True)
        write_attempt(R.daily(kept), root, "agg_ip_daily", batch, attempt, by_day=True)
        write_attempt(R.hourly(kept).withColumn("day", F.to_date("hour")), root, "agg_threat_hourly", batch, attempt, by_day=True)
        write_attempt(R.first_seen(kept), root, "first_seen", batch, attempt)
        finish(spark, root, batch, attempt)
    finally:
        kept.unpersist()
        rows.unpersist()


def capped(rows: DataFrame, batch: int, root: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """At most ``cap`` rows per arrival minute over all batches, and their counts per minute.
    Counts of earlier batches come from a small table; a task only passes on ``cap`` rows a
    minute.  Ties are broken by a hash of the row, so a batch that is tried again keeps the
    same rows.  The rows are persisted; the caller frees them."""
    spark = rows.sparkSession
    minute = F.date_trunc("minute", "ingested_at")
    tied = rows.withColumn("_tie", F.xxhash64(*rows.columns)).withColumn("_ts", c("ts")).withColumn("ts", c("ingested_at"))
    best = alerts.capped_per_minute(tied, cap, ["ts", "_ts", "src_ip", "_tie"]).withColumn("ts", c("_ts")).drop("_ts")
    past = _earlier(spark, root, "minutes", batch)
    if past is not None:
        used = past.groupBy("minute").agg(F.sum("rows").alias("used"))
        spot = F.row_number().over(W.partitionBy("minute").orderBy("ingested_at", "ts", "src_ip", "_tie"))
        best = (best.withColumn("minute", minute).join(used, "minute", "left").withColumn("_spot", spot)
                .where(c("_spot") + F.coalesce("used", F.lit(0)) <= cap).drop("minute", "used", "_spot"))
    best = best.drop("_tie").persist()
    return best, best.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("rows"))


def deviation_batch(found: DataFrame, batch: int, root: str) -> None:
    """A batch's newest deviation per (ip, type), in a store of its own batches."""
    attempt = uuid.uuid4().hex
    write_attempt(B.newest_alerts(found), root, "deviations", batch, attempt)
    finish(found.sparkSession, root, batch, attempt)


def start_deviations(found: DataFrame, root: str, checkpoint: str, available_now: bool = False, every: str = "5 seconds"):
    """Run what :func:`~wardlight.streaming.deviations.deviations_on_arrival` gives into the
    ``deviations`` table of ``root``, which is not the store of the log rows: each stream
    numbers its own batches."""
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (found.writeStream.foreachBatch(lambda df, batch: deviation_batch(df, batch, root)).outputMode("append")
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def start(stream: DataFrame, root: str, checkpoint: str, available_now: bool = False,
          every: str = "5 seconds", cap: int = 0):
    """Run a stream of log rows into the store."""
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    job = partial(store_batch, root=root, cap=cap)
    return (stream.writeStream.foreachBatch(lambda df, batch: job(df, batch))
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def start_alerts(spark, folder, root, checkpoint, **options):
    """Follow a folder of alert files.  A rotated file is a new file."""
    rows = alerts.stream_alerts(in_utc(spark), folder)
    return start(rows, root, checkpoint, **options)


def start_folder(spark, folder: str, pattern: str, root: str, checkpoint: str, available_now: bool = False):
    """Follow a drop folder of ``*.csv``, ``*.json``, ``*.ndjson`` or ``*.jsonl`` files;
    each file is read once.  Files may differ in their columns, so each is read by
    its own header; only their names pass the driver."""
    kind = {"csv": "csv", "json": "json"}.get(pattern.rsplit(".", 1)[-1], "lines")
    names = (in_utc(spark).readStream.format("binaryFile")
             .schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
             .option("maxFilesPerTrigger", 100).load(folder).select("path"))

    def job(batch_df, batch):
        paths = [row["path"] for row in batch_df.collect()]
        if paths:
            store_batch(flat.read_dropped(batch_df.sparkSession, paths, kind), batch, root)

    trigger = {"availableNow": True} if available_now else {"processingTime": "30 seconds"}
    return names.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def without_repeats(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Drops rows whose content was already seen within the delay (optional: stored
    batches are replay-safe without it)."""
    from ..functions import columns as C
    keyed = stream.withColumn("event_key", C.event_key(c("ts"), *[c(f) for f in C.EVENT_KEY_FIELDS]))
    return keyed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_key"])


def closed_hours(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Hourly counts of hours that are over; rows later than ``delay`` are not in
    here but still reach the log table and the additive rollups."""
    return (stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "threat_type", "severity")
            .agg(F.count(F.lit(1)).alias("events"))
            .select(c("window.start").alias("hour"), "threat_type", "severity", "events"))


def compacted(spark: SparkSession, root: str) -> str | None:
    """All finished batches as one attempt in their place: rollups, counts and states merged to
    one row per key, log rows into one sorted part per day.  Readers go over to it when it is
    finished; a batch that finishes meanwhile stays beside it.  Returns the attempt."""
    seen = visible(spark, root)
    last = seen.select(F.max("batch")).first()[0] if seen is not None else None
    if last is None:
        return None
    attempt = uuid.uuid4().hex
    merge = {
        "logs": lambda d: d.repartition("day", "src_ip", F.pmod(F.hash("ts"), F.lit(64))).sortWithinPartitions("day", "src_ip", "ts"),
        "agg_ip_daily": lambda d: R.summed(d, R.DAILY_KEYS),
        "agg_threat_hourly": lambda d: R.summed(d, ["day", *R.HOURLY_KEYS]),
        "first_seen": R.merged_first_seen,
        "deviations": B.newest_alerts,
        "minutes": lambda d: d.groupBy("minute").agg(F.sum("rows").alias("rows")),
    }
    for table in TABLES:
        if _table(spark, f"{root}/{table}") is not None:
            rows = read_table(spark, root, table).where(c("batch") <= last).drop("batch")
            write_attempt(merge[table](rows), root, table, last, attempt, by_day=table in ("logs", "agg_ip_daily", "agg_threat_hourly"))
    finish(spark, root, last, attempt, compacts=True)
    return attempt


def cleaned(spark: SparkSession, root: str, keep_hours: float = 24) -> int:
    """Deletes the folders of attempts that no reader sees and that are older than
    ``keep_hours`` (a running batch, or a reader that began before a compaction, may need
    younger ones).  Returns how many."""
    seen = visible(spark, root)
    kept = set() if seen is None else {r["attempt"] for r in seen.collect()}        # one per batch since the last compaction
    jvm, gone = spark.sparkContext._jvm, 0
    for table in TABLES:
        spot = jvm.org.apache.hadoop.fs.Path(f"{root}/{table}/attempt=*")
        fs = spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.globStatus(spot) or []:
            old = entry.getModificationTime() <= (time.time() - keep_hours * 3600) * 1000
            if old and entry.getPath().getName().removeprefix("attempt=") not in kept:
                fs.delete(entry.getPath(), True)
                gone += 1
    return gone


def new_block_batches(blocklist_stream: DataFrame, pushed, push, checkpoint: str):
    """Hands every block that was not pushed yet to ``push(df, batch)``.  ``pushed``
    is a function that returns the addresses pushed so far."""
    from ..sources.state import active_blocks, new_blocks
    job = lambda df, batch: push(new_blocks(active_blocks(df), pushed()), batch)
    return blocklist_stream.writeStream.foreachBatch(job).option("checkpointLocation", checkpoint).start()
