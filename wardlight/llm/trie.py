"""The prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns.  Peeling starts at the deepest
conversations and goes up: in each round newly ended conversations are merged with the
nodes that survived the round before, equal paths are grouped, which finds the round's
nodes with their counts, and each is truncated and goes on as one surviving row.
Everything below a node has been summed by then, so finding nodes and summing their
subtrees is one pass.  A round is one shuffle, and its grouping is pre-aggregated, so a
first turn that a third of all conversations share is no hot task.

A truncation strips the last turn together with the turns above it that exactly the same
conversations go through: nothing can join or end between them, and their nodes differ from
the lowest only by the sum of a few lengths.  Rounds are therefore as many as branchings
follow each other on one path, not as the longest conversation has turns.

Paths are numbers of 127 bits: a turn's mark is taken from its SHA-256, and a sequence's
key is the polynomial of its marks modulo 2^127 - 1, which can be continued from any
place.  Turns are therefore ordered by one range sort over conversation and turn, walked in
place with a row at a time in memory, and a conversation that spans partitions is
continued from the partition before: one conversation that holds a third of all rows is
many tasks.  Joins on a key that many conversations share are salted by conversation, and
joins on one conversation are cut into slices of turns.

Defined results: null role and text are empty; null turns come first; rows of one turn number
follow the hash of role and text, so repeated rows follow each other; turns without a
conv_id belong to no conversation; a conversation without turns (given by its id) is a
member of the root alone; no conversations give no nodes, not even a root; other columns are
not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from wardlight.llm.tables import query, table
from wardlight.session import checkpointed, shared_folder

PRIME = (1 << 127) - 1
#: Any large number below PRIME serves.
BASE = int.from_bytes(hashlib.sha256(b"turns").digest(), "big") % PRIME
SALTS, SLICE_BITS, ID_BITS = 64, 12, 12
_NOTHING = hashlib.sha256(b"").hexdigest()


def marked(turns: DataFrame) -> DataFrame:
    """conv_id, turn, mark (124 bits of a hash of role and text, as hexadecimal digits), bytes of the text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(whole, 256), 1, 31).alias("mark"),
        F.octet_length(text).cast("long").alias("bytes"))


_WALKED = "conv_id long, depth long, mark string, bytes long, key binary, total long, part int"


def _walk(batches):
    """Numbers the turns of each conversation and continues its key, row by row."""
    part, conv, key, depth, total = TaskContext.get().partitionId(), None, 0, 0, 0
    for pdf in batches:
        depths, keys, totals = [], [], []
        for c, mark, size in zip(pdf["conv_id"].tolist(), pdf["mark"], pdf["bytes"].tolist()):
            if c != conv:
                conv, key, depth, total = c, 0, 0, 0
            key, depth, total = (key * BASE + int(mark, 16)) % PRIME, depth + 1, total + size
            depths.append(depth)
            keys.append(key.to_bytes(16, "big"))
            totals.append(total)
        yield pd.DataFrame({"conv_id": pdf["conv_id"], "depth": depths, "mark": pdf["mark"], "bytes": pdf["bytes"], "key": keys,
                            "total": totals, "part": part})


def joined_key(before: bytes, key: bytes, turns: int) -> bytes:
    """Key of a sequence followed by another of so many turns."""
    return ((int.from_bytes(before, "big") * pow(BASE, turns, PRIME) + int.from_bytes(key, "big")) % PRIME).to_bytes(16, "big")


def _continued(carries):
    def run(batches):
        for pdf in batches:
            for part, (conv, depth, key, total) in carries.items():
                rows = pdf.index[(pdf["part"] == part) & (pdf["conv_id"] == conv)]
                if len(rows):
                    pdf["key"] = pdf["key"].astype(object)
                    for at in rows:
                        pdf.at[at, "key"] = joined_key(key, pdf.at[at, "key"], int(pdf.at[at, "depth"]))
                    pdf.loc[rows, "depth"] += depth
                    pdf.loc[rows, "total"] += total
            yield pdf
    return run


def walked(marks: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), mark, bytes, key of the turns so far, total of their bytes."""
    spark = marks.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("mark"), F.col("tie")]
    rows = marks.withColumn("tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_walk, _WALKED)
    rows = checkpointed(spark, rows)
    last = F.max(F.struct("conv_id", "depth", "key", "total")).alias("last")
    carries, before = {}, None
    for r in rows.groupBy("part").agg(F.min("conv_id").alias("first"), last).sort("part").collect():   # a row per partition
        conv, depth, key, total = r["last"]
        if before is not None and before[0] == r["first"]:
            carries[r["part"]] = before
            if conv == r["first"]:
                depth, key, total = depth + before[1], joined_key(before[2], bytes(key), depth), total + before[3]
        before = (conv, depth, bytes(key), total)
    if carries:
        rows = checkpointed(spark, rows.mapInPandas(_continued(carries), _WALKED))
    return rows.drop("part")


def _hashed(batches):
    """Streams (node, depth, ids) in order; a SHA-256 per node and depth."""
    at, digest = None, None
    for pdf in batches:
        done = []
        for node, depth, ids in zip(pdf["node"].tolist(), pdf["depth"].tolist(), pdf["ids"]):
            if (node, depth) != at:
                if at is not None:
                    done.append((*at, digest.hexdigest()))
                at, digest = (node, depth), hashlib.sha256()
                digest.update(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["node", "depth", "ends_sha256"])
    if at is not None:
        yield pd.DataFrame([(*at, digest.hexdigest())], columns=["node", "depth", "ends_sha256"])


def _ends(ended: DataFrame) -> DataFrame:
    """A digest of the ids that end at each node: ids are joined in short ranges first."""
    part = F.shiftright("conv_id", ID_BITS)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    lines = ended.groupBy("node", "depth", part.alias("part")).agg(ids.alias("ids"))
    return (lines.repartition("node", "depth").sortWithinPartitions("node", "depth", "part")
            .mapInPandas(_hashed, "node long, depth long, ends_sha256 string"))


def _met(rows: DataFrame) -> DataFrame:
    """Each turn with n, the conversations that share the sequence up to it, and first, the
    smallest of them; counted in salted parts, so a shared first turn is many keys."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    parts = salted.groupBy("depth", "key", "salt").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"))
    whole = parts.groupBy("depth", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    spread = parts.select("depth", "key", "salt").join(whole, ["depth", "key"])
    return salted.join(spread, ["depth", "key", "salt"]).drop("salt")


def _peeled(paths, deepest: int, spark) -> list[DataFrame]:
    """Nodes of every level, deepest first; ``paths(level)`` are the conversations that end on it."""
    found, surviving = [], None
    for level in range(deepest, -1, -1):
        ended = paths(level).select("conv_id", "stack", F.lit(1).cast("long").alias("n_convs"), *[F.lit(0).cast("long").alias(c)
                                    for c in ("n_children", "n_leaves", "below")])
        both = ended if surviving is None else ended.unionByName(surviving)
        last = F.element_at("stack", -1) if level else F.lit(None)
        keys = [last["bottom"].alias("bottom"), last["key"].alias("key")] if level else [F.lit(0).cast("long").alias("bottom")]
        nodes = both.groupBy(*keys).agg(
            F.min("conv_id").alias("conv_id"), F.first("stack").alias("stack"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "below")])
        nodes = checkpointed(spark, nodes.withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))))
        found.append(nodes)
        if level:
            spared = (F.col("n_convs") - 1) * (last["total"] - last["above"])
            surviving = nodes.select("conv_id", F.slice("stack", 1, F.size("stack") - 1).alias("stack"), "n_convs",
                                     F.lit(1).cast("long").alias("n_children"), "n_leaves", (F.col("below") + spared).alias("below"))
    return found


def trie_of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of conversations whose turns are ``rows``, as :func:`walked` gives them, and
    whose ids are ``ids`` (distinct, those without turns included)."""
    spark = rows.sparkSession
    met = checkpointed(spark, _met(rows.select("conv_id", "depth", "key", "bytes", "total")))
    runs = met.groupBy("conv_id", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max_by("key", "depth").alias("key"), F.min("first").alias("first"),
        F.max("total").alias("total"), F.min(F.col("total") - F.col("bytes")).alias("above"))
    stack = F.sort_array(F.collect_list(F.struct("bottom", "top", "key", "first", "total", "above"))).alias("stack")
    paths = ids.select(F.col("conv_id").cast("long")).join(runs.groupBy("conv_id").agg(stack), "conv_id", "left")
    paths = paths.withColumn("stack", F.coalesce("stack", F.array().cast(paths.schema["stack"].dataType)))
    folder = shared_folder(spark) + "/paths"
    paths.withColumn("level", F.size("stack")).write.partitionBy("level").parquet(folder)
    paths = spark.read.schema(paths.schema.add("level", T.IntegerType())).parquet(folder)
    deepest, top = paths.agg(F.max("level"), F.min("conv_id")).first()
    if deepest is None:
        return spark.createDataFrame([], _NODES)
    *found, root = _peeled(lambda level: paths.where(F.col("level") == level), deepest, spark)
    last = F.element_at("stack", -1)
    parent = F.when(F.size("stack") > 1, F.try_element_at("stack", F.lit(-2))["first"]).otherwise(F.lit(top)).alias("above_conv")
    ended = paths.select(F.when(F.size("stack") > 0, last["first"]).otherwise(F.lit(top)).alias("node"),
                         F.when(F.size("stack") > 0, last["bottom"]).otherwise(F.lit(0)).cast("long").alias("depth"), "conv_id")
    ends = _ends(ended).select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = root.select("conv_id", F.col("bottom").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                        "n_children", "n_leaves", F.col("below").alias("saved_tokens"))
    if found:
        level = reduce(DataFrame.unionByName, [f.drop("key") for f in found])
        level = level.select("conv_id", "n_convs", "n_children", "n_leaves", "below", parent, last["top"].alias("top"), "bottom",
                             last["total"].alias("all"))
        spots = F.sequence(F.shiftright("top", SLICE_BITS), F.shiftright("bottom", SLICE_BITS))
        level = level.withColumn("slice", F.explode(spots))
        own = (met.where(F.col("conv_id") == F.col("first"))
               .select("conv_id", F.col("n").alias("n_convs"), F.shiftright("depth", SLICE_BITS).alias("slice"), "depth", "bytes", "total"))
        each = own.join(level, ["conv_id", "n_convs", "slice"])
        lowest = F.col("depth") == F.col("bottom")
        spared = F.col("below") + (F.col("n_convs") - 1) * (F.col("all") - F.col("total") + F.col("bytes"))
        nodes = nodes.unionByName(each.select(
            "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above_conv")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            "n_convs", F.when(lowest, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", spared.alias("saved_tokens")))
    return nodes.join(ends, ["conv_id", "depth"], "left").select(*columns, F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


_NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends_sha256 string")


def prefix_trie(turns: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.  ``more`` has the conv_id of
    conversations that may have no turns."""
    marks = marked(turns)
    ids = marks.select("conv_id")
    if more is not None:
        ids = ids.unionByName(more.select(F.col("conv_id").cast("long")).where("conv_id is not null"))
    return trie_of(walked(marks), ids.distinct())


def with_shared_heads(placed: DataFrame, ids: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Rebuilt conversations, as ``walked`` wants them: the first h turns of the family's first
    conversation, then the own turns after the first h; h = crc32 of the id, modulo ``most``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = placed.where((F.col("depth") < most) & (F.col("conv_id") % family == 0))
    heads = heads.select(F.col("conv_id").alias("base"), "depth", "mark", "bytes")
    given = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base")).join(heads, "base")
    given = given.where(F.col("depth") <= h)
    own = placed.where(F.col("depth") > h)
    return given.select("conv_id", F.col("depth").alias("turn"), "mark", "bytes").unionByName(
        own.select("conv_id", F.col("depth").alias("turn"), "mark", "bytes"))


def _crc_table() -> list[int]:
    def step(x):
        return x >> 1 ^ (0xEDB88320 if x & 1 else 0)
    return [reduce(lambda x, _: step(x), range(8), n) for n in range(256)]


_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, (4294967295 - list_reduce(list_concat([4294967295::BIGINT],
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1], a >> 8))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.p <= c.h
  UNION ALL SELECT c.conv_id, t.p, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h),
l AS (SELECT conv_id, row_number() OVER w AS d, strlen(text) AS b, list(length(role) || ':' || role || text) OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
n AS (SELECT path, d, any_value(b) AS b, min(conv_id) AS conv_id, count(*) AS n FROM l GROUP BY path, d
  UNION ALL SELECT []::VARCHAR[], 0, 0, min(conv_id), count(*) FROM c HAVING count(*) > 0),
k AS (SELECT a.path, count(*) AS kids FROM n a JOIN n x ON x.d = a.d + 1 AND x.path[1:a.d] = a.path GROUP BY a.path),
s AS (SELECT a.path, sum((x.n - 1) * x.b) AS saved, count(*) FILTER (x.path NOT IN (SELECT path FROM k)) AS leaves
  FROM n a JOIN n x ON x.d >= a.d AND x.path[1:a.d] = a.path GROUP BY a.path),
z AS (SELECT c.conv_id, coalesce(max(l.d), 0) AS d, coalesce(max_by(l.path, l.d), []) AS path FROM c LEFT JOIN l USING (conv_id) GROUP BY c.conv_id),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM z GROUP BY path)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.kids, 0) AS n_children,
  s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path)
LEFT JOIN n u ON u.d = n.d - 1 AND u.path = n.path[1:n.d - 1]"""


@query("op12_prefix_trie", _SQL)
def op12(spark, folder):
    placed = walked(marked(table(spark, folder, "conversations"))).select("conv_id", "depth", "mark", "bytes")
    ids = checkpointed(spark, placed.select("conv_id").distinct())
    return trie_of(walked(with_shared_heads(placed, ids)), ids)
