"""Inputs that streams read grow in number of files, not in size of a task."""

import datetime as dt
from collections import Counter
from pathlib import Path

import pytest

from pyspark.sql import functions as F

import checks
from checks import ingest_checks
from wardlight.operators.takeover import account_takeovers
from wardlight.sources import flat

ROWS, START = 4000, dt.datetime(2024, 1, 1)
SMALL = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k",
         "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "12"}


@pytest.fixture
def small_tasks(spark, tmp_path, monkeypatch):
    """Events of two days in a folder of their own; files are cut into small tasks."""
    was = {k: spark.conf.get(k) for k in SMALL}
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") * 40).cast("decimal(18,6)"))
    spark.range(ROWS).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 90).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("view", "error", "click", "signup", "purchase"))), (F.col("id") % 5 + 1).cast("int")).alias("event_type"),
        F.concat(F.lit('{"k": '), (F.col("id") % 97).cast("string"), F.lit("}")).alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(ingest_checks, "shared_folder", lambda _: str(tmp_path / "run"))
    yield tmp_path
    for k, v in was.items():
        spark.conf.set(k, v)


def query(spark, name, folder):
    """Rows of a query, and how many files its stream was given."""
    rows = [tuple(r) for r in checks.QUERIES[name](spark, str(folder)).collect()]
    return rows, len(list(Path(folder, "run", "in").glob("part-*")))


def events_by_source(spark, folder):
    t = checks.registry.Tables(spark, str(folder))
    return sorted((r["src_ip"], r["count"]) for r in t.logs.groupBy("src_ip").count().collect())


def test_rows_with_repeats_are_written_in_many_files(spark, small_tasks):
    rows, files = query(spark, "o509_without_repeats", small_tasks)
    assert files > 10 and sorted(rows) == events_by_source(spark, small_tasks)


def test_hours_of_many_files_are_whole(spark, small_tasks):
    """More files than were once a batch: none of their rows counts as late."""
    rows, files = query(spark, "o502_closed_hours", small_tasks)
    ends = START + dt.timedelta(seconds=40 * (ROWS - 1)) - dt.timedelta(hours=1)
    times = [START + dt.timedelta(seconds=40 * i) for i in range(ROWS)]
    hours = Counter(x.replace(minute=0, second=0) for x in times)
    want = {f"{h:%Y-%m-%d %H:%M:%S}.000000": n for h, n in hours.items() if h + dt.timedelta(hours=1) <= ends}
    got = Counter()
    for hour, _, _, n in rows:
        got[hour] += n
    assert files > 10 and dict(got) == want


@pytest.mark.parametrize("name", ["o006_drop_folder", "o006_json_drop_folder"])
def test_dropped_rows_are_written_in_many_files(spark, small_tasks, name):
    rows, files = query(spark, name, small_tasks)
    assert files > 10 and sorted(rows) == events_by_source(spark, small_tasks)


def test_dropped_files_of_one_layout_are_one_scan(spark, tmp_path):
    """And files of other columns are read by their own."""
    bodies = {"a.csv": "data.srcip,data.dest_ip\n10.0.0.1,10.9.0.1\n", "b.csv": "data.srcip,data.dest_ip\n10.0.0.2,\n",
              "c.csv": "data.dest_ip,data.srcip,data.dstip\n10.9.0.3,10.0.0.3,\n"}
    for name, text in bodies.items():
        (tmp_path / name).write_text(text)
    rows = flat.read_dropped(spark, [str(tmp_path / n) for n in bodies], "csv")
    assert sorted(map(tuple, rows.select("src_ip", "dst_ip").collect())) == [("10.0.0.1", "10.9.0.1"), ("10.0.0.2", ""), ("10.0.0.3", "")]
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2
    lines = ['{"data.srcip": "10.0.0.1"}', '{"data.srcip": "10.0.0.2", "data.dstip": "10.9.0.2"}', '{"data.srcip": "10.0.0.3"}\n{odd']
    for i, line in enumerate(lines):
        (tmp_path / f"{i}.jsonl").write_text(line + "\n")
    rows = flat.read_dropped(spark, [str(tmp_path / f"{i}.jsonl") for i in range(3)], "lines")
    assert sorted(map(tuple, rows.select("src_ip", "dst_ip").collect())) == [("10.0.0.1", ""), ("10.0.0.2", "10.9.0.2"), ("10.0.0.3", "")]
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2


def test_takeovers_are_found_once(spark):
    """The countries known before come without a second copy of the findings."""
    at = lambda minutes: START + dt.timedelta(minutes=minutes)
    rows = [("u", "10.0.0.1", at(0), "login_success", "India", 1), *[("u", "10.0.0.2", at(9), "login_success", "Germany", 2)] * 2,
            ("u", "10.0.0.2", at(12), "login_success", "Brazil", 3), (None, "10.0.0.3", at(0), "login_success", "India", 4),
            *[(None, "10.0.0.4", at(20 + i), "brute_force", "India", 10 + i) for i in range(5)],
            (None, "10.0.0.4", at(30), "login_success", "India", 5)]
    found = account_takeovers(spark.createDataFrame(rows, "username string, src_ip string, ts timestamp, threat_type string, country string, event_id long"))
    got = sorted((r["event_id"], r["failures"], r["new_country"], r["severity"], r["usual_countries"]) for r in found.collect())
    assert got == [(2, 0, True, "high", ["India"])] * 2 + [(3, 0, True, "high", ["Germany", "India"]), (5, 5, False, "high", [])]
    assert found._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4
