"""Reference files: network topology and indicators."""

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fixed as X

IOC_SCHEMA = ("indicator string, type string, actor string, campaign string, malware string, confidence int, "
              "source string, tlp string, `references` array<string>, first_seen string")


def _name(text: str) -> str:
    return re.sub(r" ", "_", text.strip().lower())


def read_topology(spark: SparkSession, path) -> DataFrame:
    """(ip, attrs) from a CSV with an address column under one of six names; the last
    row of an address wins and empty values are left out."""
    raw = spark.read.option("header", True).csv(path)
    return topology_rows(raw.withColumn("_place", F.monotonically_increasing_id()))


def topology_rows(raw: DataFrame) -> DataFrame:
    """As :func:`read_topology` for rows with their place in the file (``_place``)."""
    names = {column: _name(column) for column in raw.columns if column != "_place"}
    found = [x for x in X.TOPOLOGY_IP_COLUMNS if x in names.values()]
    if not found:
        raise ValueError("the file has no address column")
    cell = {new: F.trim(F.coalesce(F.col(f"`{old}`").cast("string"), F.lit(""))) for old, new in names.items()}
    ip = cell.pop(found[0])
    attrs = F.map_filter(F.create_map(*[x for n, v in cell.items() for x in (F.lit(n), v)])
                         if cell else F.create_map().cast("map<string,string>"), lambda k, v: v != "")
    rows = raw.select(ip.alias("ip"), attrs.alias("attrs"), "_place").where("ip <> ''")
    return rows.groupBy("ip").agg(F.max_by("attrs", "_place").alias("attrs"))


def read_indicators(spark: SparkSession, path) -> DataFrame:
    """Indicator list (one JSON array)."""
    return spark.read.schema(IOC_SCHEMA).option("multiLine", True).json(path).where("indicator is not null")
