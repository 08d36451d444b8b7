"""Hard negatives by a secondary-sort shuffle.

An anchor's positives are its best other rows of the same label.  A positive opens a
window of scores, from a least to a most share of its own; the window's hard negatives
are the best rows of other labels in it.  All that is settled by one stream per anchor,
sorted by descending score: pair scores are packed into keys (anchor, descending score,
id), ``repartitionAndSortWithinPartitions`` deals and sorts them, and an iterator opens a
window at each positive and hands negatives to the open windows, one pair at a time.  No
anchor's pairs are ever held together: the state is the open windows and, for windows of
the current score, as many negatives as a window takes.

Anchors and rows are scored in blocks of packed vectors, every anchor block against every
row block.  Not all pairs are shuffled: a first pass keeps each block's best rows of the
anchor's label, which gives the positives; a second pass, knowing the windows, keeps of
each block only the rows that could be among a window's first.  Both keep a superset of
what the stream needs, so the result is that of sorting all pairs; an anchor sends
at most (windows x negatives) rows a block.

Defined results: rows with a null label, a null or empty vector, or a null or non-finite
component take no part; vectors of another length are never compared; rows of one vec_id
are rows of their own, and each is an anchor where its id is; a null vec_id is last in
ties and no anchor; ties go to the smaller vec_id; scores beyond a long are the nearest
long; a window holds nothing for a score below 0 (its least bound is above its most);
fewer rows than asked give fewer; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from wardlight.llm.tables import query, table
from wardlight.session import checkpointed

POSITIVES, NEGATIVES, LEAST, MOST, EVERY = 5, 3, 50, 95, 50
ROW_BLOCK, ANCHOR_BLOCK = 4096, 512
_TOP = np.iinfo(np.int64).max
_NONE = np.iinfo(np.int64).min                       # below every score
_EXACT = float(1 << 53)


def usable(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id (null: the largest long), label, size, vector of the rows that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & good)
    return rows.select(F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(_TOP)).alias("vec_id"),
                       F.col("label").cast("long").alias("label"), F.size("embedding").alias("size"),
                       F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond what doubles hold exactly, by Python's integers."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= _EXACT:
        whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
        return np.clip(whole[0] @ whole[1].T, -_TOP, _TOP).astype(np.int64)
    return (a @ b.T).astype(np.int64)


def window_of(score: int, least: int, most: int) -> tuple[int, int]:
    """Least and most score of a positive's negatives: least% and most% of its own."""
    return -(-least * score // 100), most * score // 100


_BLOCK = "size int, block long, content binary"


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["vec_id", "row"])                    # so that the first of equal scores has the smaller id
    content = pickle.dumps((np.floor(256.0 * np.array(pdf["vector"].tolist(), np.float64)),
                            *[pdf[c].to_numpy(np.int64) for c in ("row", "vec_id", "label")]), 5)
    return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "block": [int(pdf["block"].iloc[0])], "content": [content]})


def _block_of(total: int, most: int):
    """A block number by a hash of the row, for about ``most`` of ``total`` rows each."""
    return F.pmod(F.xxhash64("row"), F.lit(max(1, -(-total * 5 // (most * 4))))).alias("block")


def _blocks(rows: DataFrame, total: int, most: int) -> DataFrame:
    """Packed blocks of about ``most`` rows of one vector length."""
    return rows.select("*", _block_of(total, most)).groupBy("size", "block").applyInPandas(_packed, _BLOCK)


def _firsts(scores, allowed, count):
    """(anchor, row) places of each anchor's first ``count`` allowed rows, by score, then by place."""
    left, lines, out = np.where(allowed, scores, _NONE), np.arange(len(scores)), []
    for _ in range(count):
        at = left.argmax(axis=1)
        found = np.flatnonzero(left[lines, at] != _NONE)
        if not len(found):
            break
        out.append((found, at[found]))
        left[lines, at] = _NONE
    return out


def _pairs(positives: int):
    """A block's candidates for the positives of each anchor."""
    def run(batches):
        for pdf in batches:
            for asked, held in zip(pdf["asked"], pdf["held"]):
                (a, rows, ids, labels), (b, b_rows, b_ids, b_labels) = pickle.loads(asked), pickle.loads(held)
                scores = scores_of(a, b)
                allowed = (labels[:, None] == b_labels[None, :]) & (rows[:, None] != b_rows[None, :])
                for q, d in _firsts(scores, allowed, positives):
                    yield pd.DataFrame({"anchor": rows[q], "anchor_id": ids[q], "row": b_rows[d], "vec_id": b_ids[d], "score": scores[q, d]})
    return run


_POSITIVE = "anchor long, anchor_id long, row long, vec_id long, score long"


def _candidates(negatives: int, least: int, most: int):
    """A block's candidates for the negatives of each anchor's windows."""
    def run(batches):
        for pdf in batches:
            for asked, held, windows in zip(pdf["asked"], pdf["held"], pdf["windows"]):
                (a, rows, ids, labels), (b, b_rows, b_ids, b_labels) = pickle.loads(asked), pickle.loads(held)
                known, tops = pickle.loads(windows)
                scores, other = scores_of(a, b), labels[:, None] != b_labels[None, :]
                kept = np.zeros(scores.shape, bool)
                for turn in range(tops):
                    bounds = [window_of(known[r][turn], least, most) if len(known.get(r, ())) > turn else (1, 0) for r in rows.tolist()]
                    low, high = np.array(bounds, np.int64).T
                    allowed = other & (scores >= low[:, None]) & (scores <= high[:, None])
                    for q, d in _firsts(scores, allowed, negatives):
                        kept[q, d] = True
                q, d = np.nonzero(kept)
                yield pd.DataFrame({"anchor": rows[q], "anchor_id": ids[q], "row": b_rows[d], "vec_id": b_ids[d], "score": scores[q, d]})
    return run


def pack_key(anchor: int, score: int, vec_id: int, row: int) -> bytes:
    """Bytes whose order is (anchor, descending score, id, row)."""
    return struct.pack(">QQQQ", anchor, _TOP - score, vec_id + _TOP + 1, row)


def unpack_key(key: bytes) -> tuple[int, int, int]:
    anchor, score, vec_id, _ = struct.unpack(">QQQQ", key)
    return anchor, _TOP - score, vec_id - _TOP - 1


def _anchor_partition(key: bytes) -> int:
    return zlib.crc32(key[:8])


def mine(pairs, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST):
    """Streams (key, (anchor_id, is_positive)) in key order; yields
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    current, opened, windows, level, waiting = None, 0, [], None, []
    for key, (anchor_id, positive) in pairs:
        anchor, score, vec_id = unpack_key(key)
        if anchor != current:
            current, opened, windows, level = anchor, 0, [], None
        if score != level:                                     # negatives of this very score, for windows yet to open on it
            level, waiting = score, []
            windows = [w for w in windows if w[0] <= score and w[4] < negatives]
        if positive:
            if opened < positives:
                opened += 1
                low, high = window_of(score, least, most)
                if low <= high:
                    windows.append([low, high, vec_id, score, 0])
                    if high == score:                          # only a score of 0, or a share of 100 and more
                        for negative in waiting:
                            windows[-1][4] += 1
                            yield anchor_id, vec_id, windows[-1][4], negative, score, score
        else:
            if len(waiting) < negatives:
                waiting.append(vec_id)
            for window in windows:
                if window[0] <= score <= window[1] and window[4] < negatives:
                    window[4] += 1
                    yield anchor_id, window[2], window[4], vec_id, window[3], score


_MINED = T.StructType([T.StructField(n, T.IntegerType() if n == "rank" else T.LongType()) for n in
                       ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")])


def _met(held: DataFrame, asking: DataFrame, parts: int) -> DataFrame:
    """Every anchor block meets every row block: row blocks are dealt over ``parts`` keys,
    anchor blocks repeated for each."""
    repeated = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return held.repartition(parts, "size", "part").join(repeated.repartition(parts, "size", "part"), ["size", "part"])


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   least: int = LEAST, most: int = MOST) -> DataFrame:
    """Anchors are rows whose vec_id is divisible by ``every``; ``least`` and ``most`` are
    per cent of the positive's score, at most 100."""
    if not 0 <= least <= most <= 100:
        raise ValueError("0 <= least <= most <= 100 is wanted")
    spark = vectors.sparkSession
    rows = checkpointed(spark, usable(vectors))
    asks = (F.col("vec_id") != _TOP) & (F.col("vec_id") % every == 0)
    total, anchors = rows.agg(F.count("*"), F.count_if(asks)).first()
    held = checkpointed(spark, _blocks(rows, total, ROW_BLOCK))
    parts = max(1, min(1024, -(-total // ROW_BLOCK)))
    held = held.select("size", F.pmod("block", F.lit(parts)).cast("int").alias("part"), F.col("content").alias("held"))
    asking = checkpointed(spark, _blocks(rows.filter(asks), anchors, ANCHOR_BLOCK))
    asking = asking.select("size", "block", F.col("content").alias("asked"))
    near = _met(held, asking, parts).select("asked", "held").mapInPandas(_pairs(positives), _POSITIVE)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id", "row")
    chosen = near.withColumn("spot", F.row_number().over(order)).filter(F.col("spot") <= positives).drop("spot")
    chosen = checkpointed(spark, chosen)
    # each anchor block gets the scores of its anchors' positives
    place = rows.filter(asks).select(F.col("row").alias("anchor"), "size", _block_of(anchors, ANCHOR_BLOCK))
    windows = chosen.join(place, "anchor").groupBy("size", "block").applyInPandas(_windows, "size int, block long, windows binary")
    asking = checkpointed(spark, asking.join(windows, ["size", "block"]))
    far = (_met(held, asking.drop("block"), parts).select("asked", "held", "windows")
           .mapInPandas(_candidates(negatives, least, most), _POSITIVE))
    both = far.withColumn("positive", F.lit(False)).unionByName(chosen.withColumn("positive", F.lit(True)))
    keyed = both.rdd.map(lambda r: (pack_key(r[0], r[4], r[3], r[2]), (r[1], r[5])))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    streamed = keyed.repartitionAndSortWithinPartitions(parts, _anchor_partition)
    found = streamed.mapPartitions(lambda pairs: mine(pairs, positives, negatives, least, most))
    known = lambda c: F.when(F.col(c) != _TOP, F.col(c)).alias(c)
    return spark.createDataFrame(found, _MINED, verifySchema=False).select(
        "anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def _windows(pdf: pd.DataFrame) -> pd.DataFrame:
    """The scores of the positives of a block's anchors; at most ANCHOR_BLOCK anchors on the average."""
    known = {int(a): sorted(map(int, s), reverse=True) for a, s in pdf.groupby("anchor")["score"]}
    tops = max(map(len, known.values()))
    return pd.DataFrame({"size": [int(pdf["size"].iloc[0])], "block": [int(pdf["block"].iloc[0])],
                         "windows": [pickle.dumps((known, tops), 5)]})


_SQL = f"""
WITH good AS (SELECT vec_id, row_number() OVER () AS r,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, a.r AS anchor, d.vec_id, d.r, a.label = d.label AS same, list_dot_product(a.v, d.v)::BIGINT AS score
  FROM good a JOIN good d ON a.vec_id % {EVERY} = 0 AND a.r <> d.r AND len(a.v) = len(d.v)),
p AS (SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, r) <= {POSITIVES}),
n AS (SELECT p.anchor_id, p.anchor, p.vec_id AS positive_id, p.r AS pr, p.score AS positive_score, d.vec_id AS negative_id, d.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY d.score DESC, d.vec_id, d.r) AS rank
  FROM p JOIN pairs d ON d.anchor = p.anchor AND NOT d.same
    AND {LEAST} * p.score <= 100 * d.score AND 100 * d.score <= {MOST} * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}"""


@query("op11_hard_negatives", _SQL)
def op11(spark, folder):
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", changed))
