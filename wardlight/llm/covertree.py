"""Exact top-k by inner product with cover trees over queries and data together.

Vectors are turned into integers, floor(256 x).  Data are grouped around a bounded
sample of pivots, then cut into blocks of at most ``DATA_BLOCK`` rows, so one frequent
vector is many blocks; queries are cut into blocks of ``QUERY_BLOCK``.  Each block is
indexed by a cover tree: a node's points lie within its covering radius of its centre,
its children's centres are at least a share of that radius apart (at most ``FANOUT`` of
them), and their radii are measured.  A pair of blocks is searched by descending both
trees: for nodes with centres q and d and radii r and s no inner product exceeds
qd + |q| s + |d| r + r s, so a pair of nodes is dropped where that is below the worst
k-th score of its queries.  A query starts with its k-th score over a bounded sample of
data, which prunes whole blocks.  Blocks of pairs give k rows a query at most; the last
ranking merges them.

Defined results: vectors that are null, empty, or hold null or non-finite parts take no
part; vectors of another length are never compared; rows of one vec_id are rows of their
own, each a candidate of the other; a null vec_id is a candidate (last in ties), not a
query; ties go to the smaller vec_id; scores beyond a long are the nearest long; fewer
rows than k give fewer ranks; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm.tables import query, share_of, table
from wardlight.session import checkpointed

K, EVERY = 5, 50
DATA_BLOCK, QUERY_BLOCK = 4096, 4096
SAMPLE, MOST_PIVOTS = 2048, 256
LEAF, FANOUT, SHARE = 128, 16, 1 / 1.3
_NO_ID = np.iinfo(np.int64).max
_EXACT = float(1 << 53)


class CoverTree:
    """Nodes in arrays; a node's points are ``order[start:end]``."""

    def __init__(self, points: np.ndarray):
        self.centre, self.radius, self.norm, self.span, self.children = [], [], [], [], []
        self.order = np.arange(len(points))
        self._grow(points, 0, len(points), points[0] if len(points) else None)
        self.centre = np.array(self.centre)

    def _grow(self, points, start, end, centre):
        at, rows = len(self.centre), self.order[start:end]
        far = np.sqrt(((points[rows] - centre) ** 2).sum(axis=1))
        radius = float(far.max()) * (1 + 1e-12)
        self.centre.append(centre)
        self.radius.append(radius)
        self.norm.append(float(np.sqrt((centre ** 2).sum())))
        self.span.append((start, end))
        self.children.append([])
        if end - start <= LEAF or radius == 0:
            return at
        own, nearest, centres = np.zeros(len(rows), int), far, [centre]
        while len(centres) < FANOUT and nearest.max() > SHARE * radius:
            new = points[rows[int(nearest.argmax())]]
            d = np.sqrt(((points[rows] - new) ** 2).sum(axis=1))
            closer = d < nearest
            own[closer], nearest = len(centres), np.minimum(d, nearest)
            centres.append(new)
        self.order[start:end] = rows[np.argsort(own, kind="stable")]
        for i, c in enumerate(centres):
            size = int((own == i).sum())
            if size:
                self.children[at].append(self._grow(points, start, start + size, c))
            start += size
        return at


def _products(a: np.ndarray, b: np.ndarray):
    """Integer inner products; beyond what doubles hold exactly, by Python's integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
        top = np.iinfo(np.int64)
        return np.clip(whole[0] @ whole[1].T, top.min, top.max).astype(np.int64)
    return (a @ b.T).astype(np.int64)


class Search:
    """The k best of each query so far, as arrays of scores, ids and row numbers."""

    def __init__(self, queries, rows, floor, k):
        self.queries, self.rows, self.k, self.floor = queries, rows, k, floor
        self.best = [(np.zeros(0, np.int64),) * 3 for _ in rows]
        self.worst = floor.astype(np.float64)

    def add(self, places, points, ids, rows, small):
        """small: no inner product is beyond what doubles hold exactly."""
        asked = self.queries[places]
        scores = asked @ points.T if small else _products(asked, points)
        above = scores >= self.worst[places][:, None]
        for q in np.flatnonzero(above.any(axis=1)):
            at = places[q]
            good = np.flatnonzero(above[q] & (rows != self.rows[at]))
            if not len(good):
                continue
            line = scores[q, good].astype(np.int64)
            s, i, r = (np.concatenate(x) for x in zip(self.best[at], (line, ids[good], rows[good])))
            keep = np.lexsort((r, i, -s))[:self.k]
            self.best[at] = s[keep], i[keep], r[keep]
            if len(keep) == self.k:
                self.worst[at] = max(self.worst[at], float(s[keep[-1]]))


def dual_search(search: Search, qtree: CoverTree, points, ids, rows, dtree: CoverTree):
    """Adds a data block to a search."""
    if not len(points) or not len(search.rows):
        return
    small = np.abs(search.queries).max() * np.abs(points).max() * points.shape[1] < _EXACT

    def bound(q, d):
        exact = qtree.centre[q] @ dtree.centre[d]
        top = (exact + qtree.norm[q] * dtree.radius[d] + dtree.norm[d] * qtree.radius[q]
               + qtree.radius[q] * dtree.radius[d])
        return top + 1e-9 * abs(top) + 1e-6
    todo = [(bound(0, 0), 0, 0)]
    while todo:
        top, q, d = todo.pop()
        places = qtree.order[slice(*qtree.span[q])]
        if top < search.worst[places].min():
            continue
        qs, ds = qtree.children[q], dtree.children[d]
        if not qs and not ds:
            part = dtree.order[slice(*dtree.span[d])]
            search.add(places, points[part], ids[part], rows[part], small)
        elif ds and (not qs or dtree.radius[d] >= qtree.radius[q]):
            todo += sorted((bound(q, c), q, c) for c in ds)             # the best is taken first
        else:
            todo += sorted((bound(c, d), c, d) for c in qs)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id (null: the largest long), row (a number of its own), size, vector: of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    return rows.select(F.coalesce("vec_id", F.lit(_NO_ID)).alias("vec_id"), F.monotonically_increasing_id().alias("row"), F.size("embedding").alias("size"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def _whole(vectors) -> np.ndarray:
    return np.floor(256.0 * np.array(vectors.tolist(), np.float64))


def _near(pivots):
    """Place of the nearest pivot of the vector's length."""
    def of(batches):
        for pdf in batches:
            place = np.zeros(len(pdf), np.int64)
            for size, at in pdf.groupby("size").indices.items():
                if size in pivots:
                    x, p = _whole(pdf["vector"].iloc[at]), pivots[size]
                    place[at] = ((p ** 2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pdf.assign(near=place)
    return of


_BLOCK = "size int, block long, rows int, content binary"


def _block(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("row")
    points = _whole(pdf["vector"])
    ids = pdf["vec_id"].to_numpy(np.int64)
    content = pickle.dumps((points, ids, pdf["row"].to_numpy(np.int64), CoverTree(points)), 5)
    return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "rows": [len(pdf)],
                         "content": [content]})


def _query_block(sample, k):
    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        points, rows = _whole(pdf["vector"]), pdf["row"].to_numpy(np.int64)
        floor = np.full(len(pdf), float("-inf"))
        known = sample.get(int(pdf["size"].iloc[0]))
        if known is not None and len(known[0]) > k:
            for at in range(0, len(points), 256):
                scores = _products(points[at:at + 256], known[0]).astype(np.float64)
                scores[rows[at:at + 256, None] == known[1][None, :]] = float("-inf")
                floor[at:at + 256] = np.partition(scores, -k, axis=1)[:, -k]
        ids = pdf["vec_id"].to_numpy(np.int64)
        content = pickle.dumps((points, ids, rows, floor, CoverTree(points)), 5)
        return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                             "rows": [len(pdf)], "content": [content]})
    return make


_FOUND = "query_id long, query_row long, vec_id long, score long"


def _searched(k):
    def run(batches):
        for pdf in batches:
            for asked, held in zip(pdf["asked"], pdf["held"]):
                points, ids, rows, floor, qtree = pickle.loads(asked)
                search = Search(points, rows, floor, k)
                dual_search(search, qtree, *pickle.loads(held))
                sizes = [len(b[0]) for b in search.best]
                yield pd.DataFrame({
                    "query_id": np.repeat(ids, sizes), "query_row": np.repeat(rows, sizes),
                    "vec_id": np.concatenate([b[1] for b in search.best]),
                    "score": np.concatenate([b[0] for b in search.best])})
    return run


def _blocks(rows: DataFrame, counts: list, most: int) -> DataFrame:
    """``block``: a number for at most about ``most`` rows of a group (size, near)."""
    block, first = F.lit(-1).cast("long"), 0
    for r in counts:
        parts = max(1, -(-r["n"] * 5 // (most * 4)))
        block = F.when((F.col("size") == r["size"]) & (F.col("near") == r["near"]),
                       F.pmod(F.xxhash64("row"), F.lit(parts)) + first).otherwise(block)
        first += parts
    return rows.withColumn("block", block)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score for each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = checkpointed(spark, usable(vectors))
    total = rows.count()
    some = rows.filter(share_of(SAMPLE, total, "row")).limit(2 * SAMPLE).toPandas().sort_values("row")
    sample = {int(size): (_whole(g["vector"]), g["row"].to_numpy(np.int64)) for size, g in some.groupby("size")}
    pivots = {size: points[:max(1, min(MOST_PIVOTS, total // (4 * DATA_BLOCK)))] for size, (points, _) in sample.items()}
    placed = checkpointed(spark, rows.mapInPandas(_near(pivots), "vec_id long, row long, size int, vector array<double>, near long"))
    count = F.count("*").alias("n")
    data = _blocks(placed, sorted(placed.groupBy("size", "near").agg(count).collect()), DATA_BLOCK)
    data = data.groupBy("size", "block").applyInPandas(_block, _BLOCK)
    asking = placed.filter(F.col("vec_id") % every == 0).withColumn("near", F.lit(0).cast("long"))
    asked = sorted(asking.groupBy("size", "near").agg(count).collect())
    asking = _blocks(asking, asked, QUERY_BLOCK).groupBy("size", "block").applyInPandas(_query_block(sample, k), _BLOCK)
    # Every query block meets every data block: data blocks are spread over ``parts`` keys,
    # and query blocks are repeated for each.
    parts = max(1, min(1024, -(-total // (DATA_BLOCK // 2))))
    asking = checkpointed(spark, asking).select("size", F.col("content").alias("asked"), F.col("block").alias("asking"),
                                                F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    data = checkpointed(spark, data).select("size", F.pmod("block", F.lit(parts)).cast("int").alias("part"),
                                            F.col("content").alias("held"))
    pairs = data.repartition(parts, "size", "part").join(asking.repartition(parts, "size", "part"), ["size", "part"])
    found = pairs.select("asked", "held").mapInPandas(_searched(k), _FOUND)
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"),
                         F.when(F.col("vec_id") != _NO_ID, F.col("vec_id")).alias("vec_id"), "score")


_SQL = """
WITH good AS (SELECT vec_id, row_number() OVER () AS r,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, q.r, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
  FROM good q JOIN good d ON q.vec_id % 50 = 0 AND q.r <> d.r AND len(q.v) = len(d.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op2_cover_tree_topk", _SQL)
def op2(spark, folder):
    return top_k(table(spark, folder, "embeddings"))
