"""Stored rollups: only changed days are worked out anew, and readers miss nothing."""

import pytest
from pyspark.sql import functions as F

from wardlight.operators import counts as K, rollups as R
from wardlight.plans.sample_logs import AS_OF
from wardlight.sources import rollup_store as RS, store


@pytest.fixture
def kept(spark, plogs, tmp_path):
    rows = plogs.drop("day").where(F.col("ts") >= F.lit("2024-01-24"))
    logs, path = str(tmp_path / "logs"), str(tmp_path / "rollups")
    store.write_logs(rows.where(F.col("event_id") % 10 != 0), logs)
    return rows, logs, path


def same(a, b):
    columns = sorted(a.columns)
    assert sorted(map(str, a.select(columns).collect())) == sorted(map(str, b.select(columns).collect()))


def check_all(spark, logs, path):
    raw = store.read_logs(spark, logs)
    same(R.summed(RS.read(spark, logs, path, "agg_ip_daily"), R.DAILY_KEYS), R.daily(raw))
    same(R.summed(RS.read(spark, logs, path, "agg_threat_hourly"), R.HOURLY_KEYS), R.hourly(raw))
    same(R.merged_first_seen(RS.read(spark, logs, path, "first_seen")), R.first_seen(raw))
    same(K.technique_counts(raw, 3, "2024-01-30 13:30:00", RS.read(spark, logs, path, "agg_technique_daily")),
         K.technique_counts(raw, 3, "2024-01-30 13:30:00"))
    same(K.hourly_trend(RS.read(spark, logs, path, "agg_threat_hourly"), 24, AS_OF), K.hourly_trend(R.hourly(raw), 24, AS_OF))


def test_late_rows_count_before_and_after_a_refresh(spark, kept):
    rows, logs, path = kept
    check_all(spark, logs, path)                                    # nothing stored yet
    days = RS.refresh(spark, logs, path)
    assert len(days) >= 7 and RS.refresh(spark, logs, path) == [] == RS.changed_days(spark, logs, path)
    check_all(spark, logs, path)
    late = rows.where("event_id % 10 = 0 and to_date(ts) = date'2024-01-26'")
    assert late.count() > 0
    store.write_logs(late, logs)
    assert RS.changed_days(spark, logs, path) == ["2024-01-26"]
    check_all(spark, logs, path)                                    # that day from its rows
    plan = RS.read(spark, logs, path, "agg_ip_daily")._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-26" in plan or "19748" in plan                  # the log scan is bound to the day
    assert RS.refresh(spark, logs, path) == ["2024-01-26"]
    check_all(spark, logs, path)


def test_a_refresh_that_failed_is_done_again(spark, kept, monkeypatch):
    _, logs, path = kept
    RS.refresh(spark, logs, path)
    store.write_logs(store.read_logs(spark, logs).where("to_date(ts) = date'2024-01-27'").drop("day").limit(20), logs)
    broken = dict(RS.TABLES, first_seen=lambda _: 1 / 0)
    monkeypatch.setattr(RS, "TABLES", broken)
    with pytest.raises(ZeroDivisionError):
        RS.refresh(spark, logs, path)
    monkeypatch.undo()
    assert RS.changed_days(spark, logs, path) == ["2024-01-27"]
    check_all(spark, logs, path)
    RS.refresh(spark, logs, path)
    check_all(spark, logs, path)


def test_days_whose_logs_are_gone_stay(spark, kept):
    _, logs, path = kept
    RS.refresh(spark, logs, path)
    before = RS.read(spark, logs, path, "agg_ip_daily").where("day = date'2024-01-24'").count()
    assert store.drop_old_days(spark, logs, 6, AS_OF) == ["2024-01-24"]
    assert RS.refresh(spark, logs, path) == []
    assert before > 0 and RS.read(spark, logs, path, "agg_ip_daily").where("day = date'2024-01-24'").count() == before


def test_sketches_unite_over_days(spark, kept):
    rows, logs, path = kept
    RS.refresh(spark, logs, path)
    about = R.sketched(RS.read(spark, logs, path, "agg_sketch_daily")).first()
    exact = store.read_logs(spark, logs).agg(F.countDistinct("src_ip").alias("ips"), F.countDistinct(F.nullif("username", F.lit(""))).alias("users")).first()
    assert all(abs(about[x] - exact[x]) <= max(1, exact[x] * R.sketch_error()) for x in ("ips", "users"))
    wide = spark.range(50_000).select(F.concat(F.lit("u"), "id").alias("username"), F.col("id").cast("string").alias("src_ip"),
                                      F.lit("x").alias("threat_type"), F.timestamp_add("HOUR", (F.col("id") % 200).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("ts"))
    got = R.sketched(R.sketches(wide)).first()
    assert all(abs(got[x] - 50_000) <= 50_000 * R.sketch_error() for x in ("ips", "users"))
