"""The log store: day-partitioned Parquet, retention and size statistics."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.times import ago, moment, since, until
from ..session import checkpointed


def write_logs(df: DataFrame, path: str, mode: str = "append", spread: int = 64) -> None:
    """Day partitions, ordered by address and time inside each file.  Rows of one
    day are spread over tasks by the address and a hash of the row time, so neither a
    busy day nor a busy address makes one big task; small outputs are merged by
    adaptive execution.  Times are written as microseconds, whose file statistics
    let readers skip row groups."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    days = df.withColumn("day", F.to_date("ts"))
    (days.repartition("day", "src_ip", F.pmod(F.hash("ts"), F.lit(spread)))
     .sortWithinPartitions("day", "src_ip", "ts")
     .write.mode(mode).partitionBy("day").parquet(path))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


RETENTION_DAYS = {"agg_ip_daily": ("day", 730), "agg_threat_hourly": ("hour", 730),
                  "deviations": ("ts", 180), "auth_audit": ("ts", 90)}


def kept_logs(df: DataFrame, as_of=None) -> DataFrame:
    """Mild rows live 90 days, all others 180."""
    mild = F.coalesce(F.col("severity"), F.lit("")).isin("low", "medium", "unknown", "")
    days = F.when(mild, 90).otherwise(180)
    now = moment(as_of, df)
    return since(df, ago(now, days=180)).where(F.col("ts") + F.make_dt_interval(days) > now)


def kept_rows(df: DataFrame, table: str, as_of=None) -> DataFrame:
    column, days = RETENTION_DAYS[table]
    at = F.col(column).cast("timestamp")
    return df.where(at + F.make_dt_interval(F.lit(days)) > moment(as_of, df.withColumn(column, at), column))


def older_than(df: DataFrame, retain_days: int = 90, as_of=None) -> DataFrame:
    """Count of rows a clean-up would delete."""
    bound = ago(moment(as_of, df), days=retain_days)
    return until(df, bound).agg(F.count(F.lit(1)).alias("archived"))


def newer_than(df: DataFrame, retain_days: int = 90, as_of=None) -> DataFrame:
    """Rows a clean-up leaves."""
    return since(df, ago(moment(as_of, df), days=retain_days))


def rewrite_expired(spark: SparkSession, path: str, as_of) -> list[str]:
    """Deletes expired rows of day partitions that hold rows of both lifetimes: days of
    90 to 180 days' age are written anew without their mild rows, in the partition's own
    place; days past 180 days go whole.  Returns the rewritten days."""
    drop_old_days(spark, path, 181, as_of)
    now = moment(as_of)
    rows = read_logs(spark, path)
    mixed = rows.where((F.col("day") >= F.to_date(ago(now, days=181))) & (F.col("day") <= F.to_date(ago(now, days=90))))
    days = sorted(str(r["day"]) for r in mixed.select("day").distinct().collect())
    if days:
        left = checkpointed(spark, kept_logs(mixed, as_of))     # read before its own files are replaced
        (left.repartition("day", "src_ip", F.pmod(F.hash("ts"), F.lit(64))).sortWithinPartitions("day", "src_ip", "ts")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path))
        kept = {str(r["day"]) for r in left.select("day").distinct().collect()}
        _drop_days(spark, path, [d for d in days if d not in kept])
    return days


def _drop_days(spark: SparkSession, path: str, days: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for day in days:
        spot = jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
        spot.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(spot, True)


def drop_old_days(spark: SparkSession, path: str, retain_days: int, as_of) -> list[str]:
    """Removes whole day partitions below the limit; data files are not read."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit = spark.range(1).select(F.to_date(ago(moment(as_of), days=retain_days)).cast("string")).first()[0]
    gone = []
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("day=") and name[4:] < limit:
            fs.delete(entry.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def storage_statistics(df: DataFrame) -> DataFrame:
    """Rows, files, bytes and day partitions of a Parquet table, from the file
    metadata of each row's file; no data column is read."""
    files = (df.select("_metadata.file_path", "_metadata.file_size")
             .groupBy("file_path", "file_size").agg(F.count(F.lit(1)).alias("rows")))
    day = F.nullif(F.regexp_extract("file_path", r"day=([^/]+)", 1), F.lit(""))
    return files.agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("files"),
                     F.sum("file_size").alias("bytes"), F.countDistinct(day).alias("partitions"))
