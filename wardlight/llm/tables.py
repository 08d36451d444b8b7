"""Small helpers of the operators: input columns, sessions, registered queries."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


@functools.cache
def _shipped(application: str, spark: SparkSession) -> None:
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="run-"), "wardlight.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(path)


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once per application."""
    _shipped(spark.sparkContext.applicationId, spark)
    return spark


def query(name: str, sql: str | None = None):
    def add(fn):
        @functools.wraps(fn)
        def run(spark, folder):
            return fn(shipped(spark), folder)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and the named columns; whatever else the table has goes."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def file_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the doc_id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def share_of(least: int, of: int, *columns: str):
    """Keeps about ``least`` of ``of`` rows, the same ones at each run, by a hash of the columns."""
    parts = 1_000_003
    return F.pmod(F.xxhash64(*columns), F.lit(parts)) < (parts if of <= least else -(-parts * least // of))
