"""Sliced windows equal plain ones, also when one key holds most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from wardlight.functions.times import seconds
from wardlight.operators import sequence as S


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    data = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(20)}"
        data.append((i, key, start + dt.timedelta(seconds=rnd.randrange(0, 400_000)), rnd.choice("abc")))
    return spark.createDataFrame(data, "id int, key string, ts timestamp, v string").persist()


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


@pytest.fixture(params=[None, 200], ids=["whole", "parts"])
def cut(request):
    """Rows of a part; with 200, the hot key has about ten parts."""
    return request.param


def test_numbered(rows, cut):
    w = W.partitionBy("key").orderBy("ts", "id")
    want = rows.select("id", F.row_number().over(w).alias("seq"))
    same(S.numbered(rows, ["key"], ["ts", "id"], rows=cut).select("id", "seq"), want)


def test_parts_are_bounded_and_follow_the_order(spark):
    """One key has 95 % of an hour's rows, half of them in one second."""
    start = dt.datetime(2024, 1, 1)
    data = [(i, "hot" if i % 20 else f"k{i % 7}", start + dt.timedelta(seconds=0 if i % 2 else i % 3600)) for i in range(40_000)]
    rows = spark.createDataFrame(data, "id int, key string, ts timestamp").repartition(8)
    parts = S.parted(rows, ["key"], ["ts", "id"], rows=2_000).persist()
    sizes = {tuple(r)[:2]: r["count"] for r in parts.groupBy("key", "_part").count().collect()}
    assert max(sizes.values()) <= 2 * 2_000 and sum(k[0] == "hot" for k in sizes) >= 15
    assert all(part == 0 for key, part in sizes if key != "hot")
    edges = parts.where("key = 'hot'").groupBy("_part").agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b"))
    edges = sorted(edges.collect())
    assert all(left["b"] < right["a"] for left, right in zip(edges, edges[1:]))


def test_lent_rows_make_frames_whole(rows, cut):
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(-7, 0)
    want = rows.select("id", F.collect_list("id").over(w).alias("x"))
    both = S.lent(S.parted(rows, ["key"], ["ts", "id"], rows=cut), ["key"], ["ts", "id"], 7)
    pw = W.partitionBy("key", "_part").orderBy("ts", "id").rowsBetween(-7, 0)
    same(both.withColumn("x", F.collect_list("id").over(pw)).where("_own").select("id", "x"), want)
    with pytest.raises(ValueError):
        S.lent(both, ["key"], ["ts", "id"], S.SAMPLES)


def test_day_offsets(rows):
    day, hit = F.to_date("ts"), F.col("v") == "a"
    w = W.partitionBy("key", "d").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("d", day).select("id", F.count_if(hit).over(w).alias("n"))
    parts = S.parted(rows.withColumn("d", day), ["key"], ["ts", "id"], rows=200)
    local = F.count_if(hit).over(W.partitionBy("key", "_part", "d").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0))
    before = F.when(F.col("d") == F.col("_first_day"), F.col("_day_before")).otherwise(0)
    got = parts.withColumn("n", local).join(S.day_offsets(parts, ["key"], F.col("d"), hit), ["key", "_part"], "left")
    same(got.select("id", (F.col("n") + before).alias("n")), want)


def test_with_previous(rows, cut):
    w = W.partitionBy("key").orderBy("ts", "id")
    want = rows.select("id", F.lag("id").over(w).alias("p"))
    same(S.with_previous(rows, ["key"], ["ts", "id"], ["id"], rows=cut).select("id", F.col("prev.id").alias("p")), want)
    parts = S.parted(rows, ["key"], ["ts", "id"], rows=cut)
    assert set(S.PARTED) <= set(S.with_previous(parts, ["key"], ["ts", "id"], ["id"]).columns)


def test_latest_mark(rows, cut):
    marked = rows.withColumn("m", F.when(F.col("v") == "a", F.col("ts")))
    w = W.partitionBy("key").orderBy("ts", "id").rowsBetween(W.unboundedPreceding, 0)
    want = marked.select("id", F.max("m").over(w).alias("m"))
    same(S.with_latest_mark(marked, ["key"], ["ts", "id"], "m", rows=cut).select("id", "m"), want)


def test_gap_statistics(rows, cut):
    t = seconds(F.col("ts"))
    w = W.partitionBy("key").orderBy("ts", "id")
    want = {r["key"]: r for r in rows.withColumn("g", t - F.lag(t).over(w)).groupBy("key").agg(
        F.count("g").alias("gaps"), F.avg("g").alias("mean"), F.stddev_pop("g").alias("std"), F.min("g").alias("lo"),
        F.max("g").alias("hi")).collect()}
    got = S.gap_statistics(rows, ["key"], t, rows=cut).collect()
    assert len(got) == len(want)
    for r in got:
        x = want[r["key"]]
        assert (r["gaps"], r["min_gap"], r["max_gap"]) == (x["gaps"], x["lo"], x["hi"])
        assert r["mean_gap"] == pytest.approx(x["mean"], rel=1e-12)
        assert r["std_gap"] == pytest.approx(x["std"], rel=1e-9)


def test_long_nearly_equal_gaps_keep_their_digits(spark):
    """A difference of squares gives 0 or noise here."""
    numbers, at = [], 0.0
    for i in range(600):
        numbers.append((at,))
        at += 1e9 + (0.001 if i % 2 else -0.001)
    data = spark.createDataFrame(numbers, "t double").withColumn("key", F.lit("k"))
    exact = np.std(np.diff([n for n, in numbers]))
    for size in (None, 200):
        got = S.gap_statistics(data, ["key"], F.col("t"), rows=size).first()
        assert got["gaps"] == 599 and got["std_gap"] == pytest.approx(exact, rel=1e-3)
    single = S.gap_statistics(data.limit(1), ["key"], F.col("t")).first()
    assert single["gaps"] == 0 and single["mean_gap"] is None and single["std_gap"] is None


def test_busy_key_is_cut_before_the_shuffle(rows):
    plan = S.top_per(rows, ["key"], ["ts"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
