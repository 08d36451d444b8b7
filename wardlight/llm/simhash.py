"""SimHash near-duplicates: exact pairs within a Hamming distance by vantage-point trees.

Fingerprints are taken from every four-word shingle of the whole text.  Distinct
fingerprints are parted by a vantage-point tree: at a node those within the median
distance of its vantage point go one way, the others the other way, and a fingerprint
also visits, by the triangle inequality, each side that can hold one within the
distance.  The tree's upper levels are fitted on a bounded sample (``SAMPLE``
fingerprints) and make shards; every fingerprint lies in one shard and visits the later
shards that its ball touches.  A shard is searched by its own vantage-point tree.

Equal texts are one fingerprint, so groups of copies cost one row.  A shard returns no
pairs but, for each fingerprint, one link to its group in the shard (found with
union-find; parts of the tree that are one group are not compared again with members).
Links of all shards are joined by star contraction on Spark.

Hamming balls of random 64-bit codes overlap much, so visits grow with about the 0.75th
power of the fingerprints; the README has figures.

Defined results: null and empty texts have fingerprint zero and are linked like others;
rows of one doc_id are separate rows of one id; null doc_ids get the smallest other id
of their group, or null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.components import components
from wardlight.llm.tables import query, table, texts
from wardlight.session import checkpointed

WORDS, BITS, SEED = 4, 4, 42
SHARD_ROWS = 16_384
SAMPLE = 65_536
LEAF = 64
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str) -> int:
    """64 bits: bit j is set if it is in over half the shingles' XXH64."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split()       # ASCII letters and blanks only
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n < WORDS:
        return xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    found = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in
                         zip(starts[:n - WORDS + 1].tolist(), ends[WORDS - 1:].tolist())], "<u8", n - WORDS + 1)
    by_byte = found.view(np.uint8).reshape(-1, 8)
    if len(found) < 256:
        ones = np.unpackbits(by_byte, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in batches:
        prints = np.array([fingerprint(x.as_py()) for x in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), *batch.columns[2:]],
                                         ["doc_id", "print", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long), copy (a hash of the text)."""
    rows = texts(docs).withColumn("copy", F.xxhash64("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, print long, copy long")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def _vantage(points, rng):
    """Of a few points the one whose distances spread most, and the median distance."""
    tried = points[rng.choice(len(points), min(8, len(points)), replace=False)]
    of = [_distance(points, v) for v in tried]
    best = int(np.argmax([d.var() for d in of]))
    return tried[best], int(np.median(of[best]))


def upper_tree(sample: np.ndarray, shards: int):
    """Nodes (vantage, median, near child, far child); children below zero are shards, from -1 on."""
    rng, nodes, made = np.random.default_rng(7), [], [0]

    def grown(points, parts):
        if parts > 1 and len(points) > 1:
            v, m = _vantage(points, rng)
            near = _distance(points, v) <= m
            if near.any() and not near.all():
                at = len(nodes)
                nodes.append(None)
                share = min(parts - 1, max(1, round(parts * near.mean())))
                nodes[at] = (int(v), m, grown(points[near], share), grown(points[~near], parts - share))
                return at
        made[0] += 1
        return -made[0]
    return grown(sample, shards), nodes


def visited(tree, prints: np.ndarray, bits: int):
    """(shard, rows that lie in it, rows that visit it) of every shard."""
    root, nodes = tree
    todo = [(root, np.arange(len(prints)), np.ones(len(prints), bool))]
    while todo:
        at, rows, own = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -at - 1, rows[own], rows[~own]
            continue
        v, m, near, far = nodes[at]
        d = _distance(prints[rows], np.uint64(v)).astype(np.int64)
        side = d <= m + bits
        todo.append((near, rows[side], own[side] & (d[side] <= m)))
        side = d > m - bits
        todo.append((far, rows[side], own[side] & (d[side] > m)))


def _placed(tree, bits):
    def place(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            home, found = np.zeros(len(prints), np.int64), []
            for shard, own, guests in visited(tree, prints.view(np.uint64), bits):
                home[own] = shard
                found.append((shard, own, True))
                found.append((shard, guests, False))
            for shard, rows, own in found:
                if not own:
                    rows = rows[home[rows] < shard]      # the other of a pair visits this one's shard
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), shard, np.int32)),
                                                      pa.array(prints[rows]), pa.array(np.full(len(rows), own))],
                                                     ["shard", "print", "own"])
    return place


class _Groups:
    """Union-find over places, in numpy."""

    def __init__(self, n):
        self.parent = np.arange(n)

    def of(self, x):
        p = self.parent[x]
        while True:
            up = self.parent[p]
            if np.array_equal(up, p):
                self.parent[x] = p
                return p
            p = up

    def unite(self, a, b):
        while len(a):
            ra, rb = self.of(a), self.of(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.parent, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(prints: np.ndarray, own: np.ndarray, bits: int) -> np.ndarray:
    """For each of a shard's prints the place of its group's first; all links with one of ``own`` count."""
    groups, rng = _Groups(len(prints)), np.random.default_rng(11)
    todo = [(np.flatnonzero(own), np.arange(len(prints)))]
    while todo:
        points, seekers = todo.pop()
        known = groups.of(points)
        if (known == known[0]).all():
            seekers = seekers[groups.of(seekers) != known[0]]
        if not len(seekers):
            continue
        if len(points) > LEAF:
            v, m = _vantage(prints[points], rng)
            dp, dq = _distance(prints[points], v), _distance(prints[seekers], v).astype(np.int64)
            # Whatever lies within half the distance of one point is one group.
            ball, guests = points[dp <= bits // 2], seekers[dq <= bits // 2]
            groups.unite(np.concatenate([ball, guests]), np.full(len(ball) + len(guests), ball[0]))
            near = dp <= m
            if near.any() and not near.all():
                todo.append((points[~near], seekers[dq > m - bits]))
                todo.append((points[near], seekers[dq <= m + bits]))
                continue
        step = max(1, 262_144 // len(points))
        for i in range(0, len(seekers), step):
            some = seekers[i:i + step]
            if i and (groups.of(points) == groups.of(points[:1])).all():
                some = some[groups.of(some) != groups.of(points[:1])]
            a, b = np.nonzero(_distance(prints[some][:, None], prints[points][None, :]) <= bits)
            groups.unite(some[a], points[b])
    return groups.of(np.arange(len(prints)))


def _links(bits):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        prints = group["print"].to_numpy()
        first = linked(prints.view(np.uint64), group["own"].to_numpy(), bits) if group["own"].any() else np.arange(len(prints))
        other = first != np.arange(len(prints))
        return pd.DataFrame({"a": prints[other], "b": prints[first[other]]})
    return link


def links(prints: DataFrame, bits: int = BITS, shard_rows: int = SHARD_ROWS, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) that connect distinct prints exactly as all pairs within ``bits`` do."""
    count = prints.count()
    some = prints if count <= sample else prints.filter(
        F.pmod(F.xxhash64("print"), F.lit(1_000_003)) < math.ceil(1_000_003 * sample / count))
    known = np.sort(np.array([r[0] for r in some.select("print").collect()], np.int64)).view(np.uint64)
    tree = upper_tree(known, -(-count // shard_rows))
    placed = prints.mapInArrow(_placed(tree, bits), "shard int, print long, own boolean")
    return placed.groupBy("shard").applyInPandas(_links(bits), "a long, b long")


def _classes(rows: DataFrame, bits: int) -> DataFrame:
    """print, root: of every distinct print."""
    spark = rows.sparkSession
    prints = checkpointed(spark, rows.select("print").distinct())
    roots = components(links(prints, bits))
    return prints.join(roots, prints["print"] == roots["node"], "left").select(
        "print", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    rows = checkpointed(docs.sparkSession, fingerprints(docs).drop("copy"))
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    classes = _classes(rows, bits).join(least, "print")
    named = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = classes.select("print", "root").join(named, "root").select("print", "component_id")
    return rows.join(by_print, "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, broadcast_rows: int = 200_000) -> DataFrame:
    """Of each group the row with the smallest doc_id (then hash of the text) stays, once."""
    spark = docs.sparkSession
    rows = checkpointed(spark, fingerprints(docs))
    keys = rows.groupBy("print", "doc_id", "copy").agg(F.count("*").alias("times"))
    ranked = keys.join(_classes(rows, bits), "print")
    first = ranked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first"))
    ranked = ranked.join(first, "root").withColumn(
        "stays", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")))
    odd = checkpointed(spark, ranked.filter("not stays or times > 1").select(
        F.col("doc_id").alias("odd_id"), F.col("copy").alias("odd_copy"), "stays"))
    held = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("copy"))

    def matched(some):
        some = F.broadcast(some) if some.count() <= broadcast_rows else some
        return some, held["doc_id"].eqNullSafe(some["odd_id"]) & (held["copy"] == some["odd_copy"])
    repeated = odd.filter("stays")
    alone = held.join(*matched(odd), "left_anti").select("row.*")
    if repeated.isEmpty():
        return alone
    again = held.join(*matched(repeated), "left_semi").dropDuplicates(["doc_id", "copy"]).select("row.*")
    return alone.unionByName(again)


@query("op9_vantage_simhash")
def op9(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
