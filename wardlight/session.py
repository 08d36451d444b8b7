"""Session helper: UTC time zone and adaptive execution."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "wardlight", **conf) -> SparkSession:
    builder = (SparkSession.builder.appName(app_name)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true"))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def in_utc(spark: SparkSession) -> SparkSession:
    """Every day, hour and weekday in this library is a UTC one."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors can reach: below ``spark.checkpoint.dir``, or
    a temporary one when Spark runs on this machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return f"{base.rstrip('/')}/wardlight-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="run-")


def checkpointed(spark: SparkSession, df):
    """Cut lineage through the shared folder, so that a lost executor costs no
    recomputation from the source."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark))
    return df.checkpoint()
