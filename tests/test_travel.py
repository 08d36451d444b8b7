"""Five-second clusters against a plain model of the rule."""

import datetime as dt
import random

from pyspark.sql import functions as F

from wardlight.operators import travel as TR

START = dt.datetime(2024, 1, 1)
PLACES = {"Germany": (51.2, 10.4), "Brazil": (-14.2, -51.9), "Japan": (36.2, 138.3)}


def placed(spark, times_by_user, seed=1):
    rnd = random.Random(seed)
    data, n = [], 0
    for user, times in times_by_user.items():
        for t in times:
            country = rnd.choice(list(PLACES))
            data.append((user, "1.2.3.4", START + dt.timedelta(seconds=t), n, country, *PLACES[country]))
            n += 1
    return spark.createDataFrame(data, "username string, src_ip string, ts timestamp, event_id int, country string, "
                                       "lat double, lon double")


def model(times):
    out, anchor = {}, None
    for t in sorted(times):
        if anchor is None or t - anchor > 5.0:
            anchor = t
        out[t] = anchor
    return out


def check(spark, times_by_user, **options):
    got = TR.clusters(placed(spark, times_by_user), **options).select("username", "ts", "anchor").collect()
    assert got
    for r in got:
        secs = lambda x: round((x - START).total_seconds(), 3)
        want = {round(k, 3): round(v, 3) for k, v in model(times_by_user[r["username"]]).items()}
        assert want[secs(r["ts"])] == secs(r["anchor"])


def times(seed, n, step):
    rnd = random.Random(seed)
    t, out = 3590.0, []
    for _ in range(n):
        t += round(rnd.random() * step, 3) + 0.001
        out.append(round(t, 3))
    return out


def test_short_runs(spark):
    check(spark, {f"u{i}": times(i, 60, 12) for i in range(5)})


def test_long_runs(spark):
    users = {"bot": times(9, 400, 1.5), "calm": times(10, 20, 30)}
    check(spark, users)


def test_edge_is_greedy(spark):
    rows = spark.createDataFrame(
        [("e", "1.1.1.1", START + dt.timedelta(seconds=s), i, c, *PLACES[c])
         for i, (s, c) in enumerate([(0, "Germany"), (4, "Brazil"), (8, "Japan")])],
        "username string, src_ip string, ts timestamp, event_id int, country string, lat double, lon double")
    got = {(r["event_id"], (r["anchor"] - START).total_seconds()) for r in TR.clusters(rows).collect()}
    assert got == {(0, 0.0), (1, 0.0), (2, 8.0)}


def test_planted_travellers(plogs):
    from wardlight.operators.trails import login_events
    found = TR.impossible_travel(login_events(plogs)).where(
        F.col("username").isin("traveler.fast", "traveler.slow", "shared.account")).collect()
    by_user = {}
    for f in found:
        by_user.setdefault(f["username"], []).append(f)
    assert "traveler.slow" not in by_user
    assert [f["severity"] for f in by_user["traveler.fast"]] == ["high"]
    assert round(by_user["traveler.fast"][0]["distance_km"]) == 13093
    (one,) = by_user["shared.account"]
    assert one["severity"] == "critical" and len(one["countries"]) == 3
