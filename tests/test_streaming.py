"""Micro-batches: replay, caps, late rows, and the same answers as in batch."""

import datetime as dt

import numpy as np
import pytest

from pyspark.sql import functions as F

from wardlight.operators import baseline as B, rollups as R
from wardlight.plans.sample_logs import AS_OF
from wardlight.sources import store
from wardlight.streaming import ingest as G
from wardlight.streaming.deviations import deviations_on_arrival, in_context


def daily(spark, root):
    rows = R.summed(G.read_table(spark, root, "agg_ip_daily"), R.DAILY_KEYS)
    return sorted(map(tuple, rows.select(F.col("day").cast("string"), *R.DAILY_KEYS[1:], "events").collect()))


def test_replay_changes_nothing(spark, plogs, tmp_path):
    root = str(tmp_path)
    rows = plogs.drop("event_id")
    half = F.col("rule_level") < 8
    G.store_batch(rows.where(half), 0, root)
    G.store_batch(rows.where(~half), 1, root)
    first = daily(spark, root), G.read_table(spark, root, "logs").count()
    G.store_batch(rows.where(~half), 1, root)
    assert (daily(spark, root), G.read_table(spark, root, "logs").count()) == first
    want = sorted(map(tuple, R.daily(rows).select(F.col("day").cast("string"), *R.DAILY_KEYS[1:], "events").collect()))
    assert first[0] == want


def test_cap_counts_over_batches(spark, plogs, tmp_path):
    root = str(tmp_path)
    rows = plogs.drop("event_id").withColumn("ingested_at", F.lit("2024-02-01 00:00:10").cast("timestamp"))
    G.store_batch(rows.limit(30), 0, root, cap=50)
    G.store_batch(rows.limit(100), 1, root, cap=50)
    assert G.read_table(spark, root, "logs").count() == 50


def files_in_order(rows, folder, bounds):
    for low, high in zip(bounds, bounds[1:]):
        rows.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high))).coalesce(1).write.mode("append").parquet(folder)


def test_fifty_batches_of_deviations_equal_the_scan(spark, plogs, tmp_path):
    """And the last batch takes no longer than the tenth."""
    root, start = str(tmp_path), dt.datetime(2024, 1, 30)
    base = B.build_baselines(plogs, AS_OF).persist()
    rows = plogs.where(F.col("ts") >= F.lit(start))
    files_in_order(rows, root + "/in", [start + dt.timedelta(minutes=29 * i) for i in range(50)] + [start + dt.timedelta(days=1)])
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
    found = deviations_on_arrival(stream, base, plogs, AS_OF, hours=24)
    query = G.start_deviations(found, root + "/found", root + "/checkpoint", available_now=True)
    query.awaitTermination()
    took = [p["durationMs"]["addBatch"] for p in query.recentProgress if "addBatch" in p["durationMs"]]
    got = set(map(tuple, B.newest_alerts(G.read_table(spark, root + "/found", "deviations").drop("batch")).select("ip", "type", "severity", "ts").collect()))
    want = set(map(tuple, B.deviation_scan(plogs, base, AS_OF).select("ip", "type", "severity", "ts").collect()))
    assert got == want and len(want) > 20
    assert G.visible(spark, root + "/found").count() == len(took) == 50
    assert sorted(took[-10:])[5] <= 1.5 * sorted(took[5:15])[5]


def test_context_of_an_event_like_the_scan_s():
    times = np.array([0, 1_000_000, 1_500_000, 1_500_000, 9_000_000], np.int64)
    got = in_context(times, ["a", "b", "", "a", "c"], 3)
    assert got["recent_dsts"].tolist() == [2, 2, 3] and got["recent_gaps"].tolist() == [2, 3, 4]
    assert got["avg_gap"].tolist() == pytest.approx([0.75, 0.5, 2.25]) and got["std_gap"].tolist() == pytest.approx(
        [np.std(g, ddof=1) for g in ([1, .5], [1, .5, 0], [1, .5, 0, 7.5])])
    long = in_context(np.arange(200) * 1_000_000, [str(i) for i in range(200)], 1)
    assert long["recent_dsts"].tolist() == [50] and long["recent_gaps"].tolist() == [19]


def test_compaction_takes_the_place_of_its_batches(spark, plogs, tmp_path):
    root = str(tmp_path)
    rows = plogs.drop("event_id").withColumn("ingested_at", F.lit("2024-02-01 00:00:10").cast("timestamp"))
    assert G.compacted(spark, root) is None
    for i in range(3):
        G.store_batch(rows.where(F.col("rule_level") % 3 == i), i, root, cap=10_000)
    G.store_batch(rows.where("rule_level % 3 = 2"), 2, root, cap=10_000)             # tried again
    G.deviation_batch(plogs.select(F.col("src_ip").alias("ip"), F.col("threat_type").alias("type"), "severity",
                                   F.col("rule").alias("detail"), "ts", "event_id"), 3, root)
    before = {t: G.read_table(spark, root, t).columns for t in G.TABLES}
    logs, sums = G.read_table(spark, root, "logs").count(), daily(spark, root)
    attempt = G.compacted(spark, root)
    assert {t: G.read_table(spark, root, t).columns for t in G.TABLES} == before
    assert (G.read_table(spark, root, "logs").count(), daily(spark, root)) == (logs, sums) and logs == rows.count()
    assert G.read_table(spark, root, "agg_ip_daily").count() == R.daily(rows).count()
    assert [r["attempt"] for r in G.visible(spark, root).collect()] == [attempt]
    assert G.read_table(spark, root, "minutes").agg(F.sum("rows")).first()[0] == logs
    G.store_batch(rows.limit(5), 4, root, cap=10_000)                               # goes on beside it
    assert G.read_table(spark, root, "logs").count() == logs + 5
    assert G.cleaned(spark, root) == 0 and G.cleaned(spark, root, keep_hours=0) > 4
    assert G.read_table(spark, root, "logs").count() == logs + 5


def test_readers_see_whole_batches_and_an_empty_retry(spark, plogs, tmp_path, monkeypatch):
    root, rows = str(tmp_path), plogs.drop("event_id")
    G.store_batch(rows.where("rule_level < 8"), 0, root)
    whole = G.read_table(spark, root, "logs").count()
    monkeypatch.setattr(G.R, "first_seen", lambda _: 1 / 0)                         # fails after two tables
    with pytest.raises(ZeroDivisionError):
        G.store_batch(rows.where("rule_level >= 8"), 1, root)
    monkeypatch.undo()
    assert G.read_table(spark, root, "logs").count() == whole == sum(r[-1] for r in daily(spark, root))
    G.store_batch(rows.where("rule_level >= 8"), 1, root)
    assert G.read_table(spark, root, "logs").count() == rows.count()
    G.store_batch(rows.limit(0), 1, root)                                           # the retry has no rows
    for table in ("logs", "agg_ip_daily", "agg_threat_hourly", "first_seen"):
        assert {r[0] for r in G.read_table(spark, root, table).select("batch").distinct().collect()} == {0}
    assert G.read_table(spark, root, "logs").count() == whole


def test_a_retry_without_a_day_leaves_no_rows_of_it(spark, plogs, tmp_path):
    root, rows = str(tmp_path), plogs.drop("event_id")
    G.store_batch(rows, 0, root)
    part = rows.where(F.to_date("ts") != F.lit("2024-01-20").cast("date"))
    G.store_batch(part, 0, root)
    assert 0 < G.read_table(spark, root, "logs").count() == part.count() < rows.count()


def test_expired_rows_are_deleted(spark, plogs, tmp_path):
    path, as_of = str(tmp_path / "logs"), "2024-04-25 12:00:00"
    store.write_logs(plogs.drop("day"), path)
    want = sorted(r["event_id"] for r in store.kept_logs(plogs, as_of).select("event_id").collect())
    days = store.rewrite_expired(spark, path, as_of)
    assert days and sorted(r["event_id"] for r in store.read_logs(spark, path).select("event_id").collect()) == want
    assert 0 < len(want) < plogs.count()
