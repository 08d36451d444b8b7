"""Rollups of a log table, kept up day by day and read without gaps.

``refresh`` works out anew only the days whose log files changed since the last time, and
then notes each day's mark (number and bytes of its files, time of its last change).  ``read``
takes stored days whose mark still holds and rolls up the raw rows of the others, so late
rows count at once and a query over a year reads a year of rollup and a few hours of rows.
Days whose logs retention has deleted stay: rollups outlive rows.
"""

import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rollups as R
from .store import read_logs

#: Each gives rows with a ``day``, additive over days (sketches: by union).
TABLES = {
    "agg_ip_daily": R.daily,
    "agg_threat_hourly": lambda logs: R.hourly(logs).withColumn("day", F.to_date("hour")),
    "first_seen": lambda logs: R.first_seen(logs, by=("day",)),
    "agg_technique_daily": R.techniques,
    "agg_sketch_daily": R.sketches,
}
STATE = "rolled_up"


def marks(spark: SparkSession, logs: str) -> dict[str, str]:
    """Day to a mark that changes with its files; one entry per day partition."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(logs)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {}
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("day="):
            size = fs.getContentSummary(entry.getPath())
            found[name[4:]] = f"{size.getFileCount()}-{size.getLength()}-{entry.getModificationTime()}"
    return found


def _exists(spark, path):
    spot = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spot)


def rolled_up(spark: SparkSession, path: str) -> dict[str, str]:
    """Day to the mark of the log files that its stored rollups hold."""
    if not _exists(spark, f"{path}/{STATE}"):
        return {}
    lines = spark.read.parquet(f"{path}/{STATE}").groupBy("day").agg(F.max_by("mark", "at").alias("mark"))
    return {r["day"]: r["mark"] for r in lines.collect()}


def changed_days(spark: SparkSession, logs: str, path: str) -> list[str]:
    """Days whose stored rollups miss something."""
    known = rolled_up(spark, path)
    return sorted(day for day, mark in marks(spark, logs).items() if known.get(day) != mark)


def _of_days(rows: DataFrame, days: list[str]) -> DataFrame:
    return rows.where(F.col("day").isin([F.lit(d).cast("date") for d in days]) if days else F.lit(False))


def refresh(spark: SparkSession, logs: str, path: str) -> list[str]:
    """Brings the stored rollups up to date; returns the days worked out anew.  Files that
    arrive while it runs leave their day's mark outdated, so the next run takes the day again."""
    now = marks(spark, logs)                                   # before the rows are read
    known = rolled_up(spark, path)
    days = sorted(d for d, mark in now.items() if known.get(d) != mark)
    if days:
        rows = _of_days(read_logs(spark, logs), days)
        for table, rolled in TABLES.items():
            (rolled(rows).repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("day").parquet(f"{path}/{table}"))
        line = [(d, now[d], time.time_ns()) for d in days]
        spark.createDataFrame(line, "day string, mark string, at long").coalesce(1).write.mode("append").parquet(f"{path}/{STATE}")
    return days


def read(spark: SparkSession, logs: str, path: str, table: str) -> DataFrame:
    """A rollup with everything the log table holds now."""
    late = changed_days(spark, logs, path)
    fresh = TABLES[table](_of_days(read_logs(spark, logs), late)) if late else None
    if not _exists(spark, f"{path}/{table}"):
        return fresh
    stored = spark.read.parquet(f"{path}/{table}")
    return stored if fresh is None else stored.where(~F.col("day").isin([F.lit(d).cast("date") for d in late])).unionByName(fresh)
