"""Forest and label model: properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.functions import fixed as X
from wardlight.operators import forest as FO, recommend as RE


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(5)
    rows = [(f"10.0.0.{i}", *map(float, rng.normal(10, 1, len(X.FOREST_FEATURES)))) for i in range(300)]
    rows += [(f"99.0.0.{i}", *map(float, rng.normal(40, 1, len(X.FOREST_FEATURES)))) for i in range(5)]
    return spark.createDataFrame(rows, "ip string, " + ", ".join(f"{n} double" for n in X.FOREST_FEATURES)).persist()


def test_outliers_score_lowest(features):
    rows = FO.trained_scores(features, trees=40).orderBy("anomaly_score").collect()
    assert {r["ip"] for r in rows[:5]} == {f"99.0.0.{i}" for i in range(5)}
    share = sum(r["is_anomaly"] for r in rows) / len(rows)
    assert 0.05 <= share <= 0.12


def test_row_order_does_not_matter(features):
    a = {r["ip"]: r["anomaly_score"] for r in FO.trained_scores(features, trees=10).collect()}
    b = {r["ip"]: r["anomaly_score"] for r in FO.trained_scores(features.repartition(7).orderBy(F.rand(1)), trees=10).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_too_few_rows(features):
    assert FO.trained_scores(features.limit(4), trees=5).count() == 0


def test_saved_models_score_new_rows(spark, features, tmp_path):
    """An old model's scores of new rows don't depend on the other new rows."""
    path = str(tmp_path)
    model = FO.train_model(features, trees=40)
    FO.write_model(model, path, 3)
    FO.write_model(FO.train_model(features.where("ip < '10.0.0.2'"), trees=5), path, 4)
    assert FO.versions(spark, path) == [3, 4]
    old = FO.read_model(spark, path, 3)
    same = {r["ip"]: r["anomaly_score"] for r in FO.scores_by(old, features).collect()}
    trained = {r["ip"]: r["anomaly_score"] for r in FO.trained_scores(features, trees=40).collect()}
    assert same.keys() == trained.keys() and all(same[k] == pytest.approx(trained[k], abs=1e-9) for k in same)
    new = features.where("ip in ('10.0.0.1', '99.0.0.1')").withColumn("ip", F.concat(F.lit("new-"), "ip"))
    far = new.where("ip = 'new-10.0.0.1'").withColumns({n: F.lit(500.0) for n in X.FOREST_FEATURES}).withColumn("ip", F.lit("far"))
    got = {r["ip"]: (r["anomaly_score"], r["is_anomaly"]) for r in FO.scores_by(old, new.unionByName(far)).collect()}
    assert got["new-10.0.0.1"][0] == pytest.approx(same["10.0.0.1"]) and got["new-99.0.0.1"][0] == pytest.approx(same["99.0.0.1"])
    assert got["far"][1] and got["new-99.0.0.1"][1]
    newest = FO.read_model(spark, path)
    assert newest.nodes.select("tree").distinct().count() == 5 and newest.info.first()["rows"] == features.where("ip < '10.0.0.2'").count()


def test_wide_and_narrow_networks_cover_one_address(spark):
    from wardlight.operators import intel as N
    names = ["16.0.0.0/4", "20.0.0.0/9", "20.1.2.3/32", "20.1.2.3", "20.1.2.", "20.1.2.0/23", "0.0.0.0/0", "20.1.2.4/32", "128.0.0.0/1", "20.1.0.0/16", "20.1.0.0/17"]
    fields = ["type", "actor", "campaign", "malware", "source", "tlp"]
    iocs = spark.createDataFrame([(n, *[""] * 6, 50) for n in names], "indicator string, " + ", ".join(f"{f} string" for f in fields) + ", confidence int")
    ips = spark.createDataFrame([("20.1.2.3",), ("130.0.0.1",), ("not an address",), ("20.1.200.9",)], "ip string")
    got = {}
    for r in N.matched(ips, iocs).collect():
        got.setdefault(r["ip"], set()).add(r["indicator"])
    assert got["20.1.2.3"] == set(names) - {"20.1.2.4/32", "128.0.0.0/1"}
    assert got["130.0.0.1"] == {"0.0.0.0/0", "128.0.0.0/1"} and "not an address" not in got
    assert got["20.1.200.9"] == {"16.0.0.0/4", "20.0.0.0/9", "0.0.0.0/0", "20.1.0.0/16"}
    nodes = N.prefix_nodes(N.indicator_ranges(iocs))
    assert nodes.agg(F.min("bits")).first()[0] == N.WIDEST                      # so a key has at most 2 ** 16 addresses


def test_label_model_separates(spark):
    rng = np.random.default_rng(2)
    names = X.LABEL_FEATURES
    rows = []
    for i in range(40):
        y = float(i % 2)
        rows.append((f"e{i}", "t", *map(float, rng.normal(y * 2, 0.5, len(names))), y))
    data = spark.createDataFrame(rows, "entity string, top_threat string, " + ", ".join(f"{n} double" for n in names) + ", label double")
    bundle = RE.train_labels(data)
    assert bundle["status"] == "ready" and bundle["train_accuracy"] >= 0.95
    p = {r["entity"]: r["p"] for r in RE.probabilities(bundle, data).collect()}
    assert p["e1"] > 0.5 > p["e0"]
    assert RE.train_labels(data.limit(10))["status"] == "collecting"
