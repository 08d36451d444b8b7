"""Isolation forest over behaviour vectors.

Training rows per tree are a fixed small sample chosen by a hash rank, so growing a
tree is a small job of its own and trees grow in parallel.  Scoring streams the
vectors through the forest in Arrow batches.
"""

import sys
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..functions import fixed as X
from ..functions.columns import with_one_value
from ..session import checkpointed
from .sequence import top_per

# tasks carry the helpers below with them, so workers need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

c = F.col
TREES = 150
SAMPLE = 256
CONTAMINATION = 0.1
TREE_SCHEMA = ("tree int, node int, feature int, cut double, below int, above int, depth int, size int")


def standardised(rows, names, key="ip") -> DataFrame:
    """Columns minus their mean over their population deviation (1 where it is 0).

    The statistics are one aggregate, read as a scalar subquery."""
    stats = rows.select(F.struct(*[F.avg(n).alias(f"m_{n}") for n in names],
                                 *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).alias("s")).scalar()
    spread = lambda n: F.when(c("_s")[f"s_{n}"] > 0, c("_s")[f"s_{n}"]).otherwise(1.0)
    return (with_one_value(rows, "_s", stats)
            .select(key, *[((c(n) - c("_s")[f"m_{n}"]) / spread(n)).alias(n) for n in names]))


def tree_samples(rows, trees=TREES, size=SAMPLE, seed=42, key="ip") -> DataFrame:
    """``size`` vectors per tree, by the rank of a hash of tree and key, so the choice
    does not depend on row order.

    Only hashes low enough to rank among the first are kept (four times as many as
    needed on average; all, where there are fewer rows), so a row is copied into few
    trees however many rows there are; every task then keeps its best ``size`` rows of
    a tree before the shuffle.  ``size`` is the algorithm's sample, a parameter."""
    span = 1 << 40
    total = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    cut = F.least(F.lit(4.0 * size * span) / F.greatest(total, F.lit(1)), F.lit(float(span)))
    draw = lambda tree: F.pmod(F.xxhash64(tree, F.lit(seed), c(key)), F.lit(span))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda tree: draw(tree) < c("_cut"))
    spread = rows.withColumn("_cut", cut).withColumn("tree", F.explode(chosen)).drop("_cut")
    return top_per(spread, ["tree"], [draw(c("tree")), key], size)


def average_path(n):
    """Mean path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + np.euler_gamma) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(points: np.ndarray, rng) -> list[tuple]:
    """Nodes of one tree: random feature among the varying ones, random cut."""
    limit = int(np.ceil(np.log2(max(len(points), 2))))
    nodes, todo = [], [(0, np.arange(len(points)), 0)]
    count = 1
    while todo:
        node, rows, depth = todo.pop()
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varying):
            nodes.append((node, -1, 0.0, -1, -1, depth, len(rows)))
            continue
        feature = int(rng.choice(varying))
        cut = float(rng.uniform(low[feature], high[feature]))
        left = points[rows, feature] <= cut
        nodes.append((node, feature, cut, count, count + 1, depth, len(rows)))
        todo += [(count, rows[left], depth + 1), (count + 1, rows[~left], depth + 1)]
        count += 2
    return nodes


def train_forest(vectors, names=tuple(X.FOREST_FEATURES), trees=TREES, size=SAMPLE, seed=42, key="ip") -> DataFrame:
    """Node rows of all trees (at most ``trees`` x 511 rows)."""
    names = list(names)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        points = pdf.sort_values(key)[names].to_numpy(dtype=float)
        nodes = grow_tree(points, np.random.default_rng([seed, tree]))
        return pd.DataFrame([(tree, *n) for n in nodes],
                            columns=["tree", "node", "feature", "cut", "below", "above", "depth", "size"])

    return tree_samples(vectors, trees, size, seed, key).groupBy("tree").applyInPandas(grow, TREE_SCHEMA)


def packed(forest) -> dict:
    """Forest rows as arrays for scoring.  Their number is bounded by trees times
    nodes per tree, never by the data."""
    pdf = forest.toPandas().sort_values(["tree", "node"])
    out = []
    for _, t in pdf.groupby("tree"):
        out.append({n: t[n].to_numpy() for n in ("feature", "cut", "below", "above", "depth", "size")})
    return {"trees": out, "sample": int(pdf[pdf["depth"] == 0]["size"].max()) if len(pdf) else 0}


def path_lengths(points: np.ndarray, tree: dict) -> np.ndarray:
    """Path length of every point, all points stepping down together."""
    at = np.zeros(len(points), dtype=int)
    while True:
        feature = tree["feature"][at]
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            break
        low = points[inner, feature[inner]] <= tree["cut"][at[inner]]
        at[inner] = np.where(low, tree["below"][at[inner]], tree["above"][at[inner]])
    return tree["depth"][at] + average_path(tree["size"][at])


def raw_scores(vectors, forest, names=tuple(X.FOREST_FEATURES), key="ip") -> DataFrame:
    """(key, raw): minus the usual anomaly measure, so low is strange."""
    names = list(names)
    model = vectors.sparkSession.sparkContext.broadcast(packed(forest))

    def score(batches):
        trees, scale = model.value["trees"], float(average_path([model.value["sample"]])[0]) or 1.0
        for pdf in batches:
            points = pdf[names].to_numpy(dtype=float)
            depth = sum(path_lengths(points, t) for t in trees) / len(trees)
            yield pd.DataFrame({key: pdf[key], "raw": -np.power(2.0, -depth / scale)})

    return vectors.select(key, *names).mapInPandas(score, f"{key} string, raw double")


def anomaly_scores(vectors, forest, contamination=CONTAMINATION, names=tuple(X.FOREST_FEATURES), key="ip") -> DataFrame:
    """Decision score (negative for outliers) with the offset at the contamination
    quantile, taken from a sketch of bounded size (rank error at most 1e-5)."""
    raw = checkpointed(vectors.sparkSession, raw_scores(vectors, forest, names, key))
    offset = raw.select(F.percentile_approx("raw", F.lit(contamination), F.lit(100_000))).scalar()
    return raw.select(key, (c("raw") - offset).alias("anomaly_score")).withColumn(
        "is_anomaly", c("anomaly_score") < 0)


def trained_scores(features, least=5, key="ip", **options) -> DataFrame:
    """Standardise, train and score feature vectors in one go; empty when there are
    fewer than ``least`` of them."""
    vectors = standardised(features.withColumns({n: c(n).cast("double") for n in X.FOREST_FEATURES}),
                           X.FOREST_FEATURES, key)
    scored = anomaly_scores(vectors, train_forest(vectors, key=key, **options), key=key)
    enough = features.agg(F.count(F.lit(1)).alias("n")).scalar()
    return scored.where(enough >= least)


# --- saved models -----------------------------------------------------------------

class Model(NamedTuple):
    """What scoring needs: nodes of the trees, mean and spread per feature, the offset."""

    nodes: DataFrame
    scaling: DataFrame
    info: DataFrame


def scaling_of(rows, names=tuple(X.FOREST_FEATURES)) -> DataFrame:
    """(feature, mean, spread): one row per feature."""
    found = [F.struct(F.lit(n).alias("feature"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("s")) for n in names]
    return (rows.agg(F.array(*found).alias("f")).select(F.explode("f").alias("f"))
            .select("f.feature", "f.mean", F.when(c("f.s") > 0, c("f.s")).otherwise(1.0).alias("spread")))


def scaled(rows, scaling, names=tuple(X.FOREST_FEATURES), key="ip") -> DataFrame:
    """Columns by a given scaling, whichever rows it came from."""
    by_name = scaling.select(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "spread")))).alias("s")).scalar()
    return with_one_value(rows, "_s", by_name).select(
        key, *[((c(n) - c("_s")[n]["mean"]) / c("_s")[n]["spread"]).alias(n) for n in names])


def _doubles(features, names):
    return features.withColumns({n: c(n).cast("double") for n in names})


def train_model(features, contamination=CONTAMINATION, names=tuple(X.FOREST_FEATURES), key="ip", **options) -> Model:
    """A forest with the scaling and the offset of the rows that it was trained on."""
    rows = _doubles(features, names)
    scaling = checkpointed(features.sparkSession, scaling_of(rows, names))
    vectors = scaled(rows, scaling, names, key)
    nodes = checkpointed(features.sparkSession, train_forest(vectors, names, key=key, **options))
    info = raw_scores(vectors, nodes, names, key).agg(
        F.percentile_approx("raw", F.lit(contamination), F.lit(100_000)).alias("cut"), F.count(F.lit(1)).alias("rows"))
    return Model(nodes, scaling, info)


def write_model(model: Model, path: str, version: int) -> None:
    """A version of its own beside the others; it counts when its ``info``, written last, is there."""
    for name, rows in zip(Model._fields, model):
        rows.coalesce(1).withColumn("version", F.lit(version)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/{name}")


def versions(spark, path: str) -> list[int]:
    return sorted(r["version"] for r in spark.read.parquet(f"{path}/info").select("version").distinct().collect())


def read_model(spark, path: str, version: int | None = None) -> Model:
    """A version, by default the newest."""
    wanted = versions(spark, path)[-1] if version is None else version
    return Model(*[spark.read.parquet(f"{path}/{name}").where(c("version") == wanted).drop("version") for name in Model._fields])


def scores_by(model: Model, features, names=tuple(X.FOREST_FEATURES), key="ip") -> DataFrame:
    """Scores of rows, seen in training or not, by a model's own scaling and offset."""
    raw = raw_scores(scaled(_doubles(features, names), model.scaling, names, key), model.nodes, names, key)
    return raw.select(key, (c("raw") - model.info.select("cut").scalar()).alias("anomaly_score")).withColumn(
        "is_anomaly", c("anomaly_score") < 0)
