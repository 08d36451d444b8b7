"""Size-partitioned MinHash containment: short benchmark items inside long documents.

Items are partitioned by their number of distinct five-word shingles (classes end at
powers of two).  An item's sketch is its ``k`` smallest shingle hashes; ``k`` exceeds,
by :data:`SPARE`, the shingles that an item of the class may miss at the threshold, so
every document that contains the item holds some of its sketch: candidates miss nothing.
Document shingles are probed by hash, candidates need the sketch hits that the threshold
implies, and candidates are verified by containment of the shingles themselves.  All of it is DataFrame operations.

Words are runs of letters and digits, lower-cased.  A text of one to four words is one
shingle, the whole sequence, so such an item matches a document with just these words.

Defined results: null and empty texts have no shingles and match nothing; rows of one
doc_id are one document and count their shingles together; rows of one item_id are
separate items of which the best match is kept; null ids are ids of their own; shingles
count once however often they are repeated; no rows for empty tables; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardlight.llm.tables import query, table
from wardlight.session import checkpointed

WORDS = 5
THRESHOLD = 0.8
SPARE = 2
#: Up to so many rows of item shingles or candidate ids are broadcast (a few MB); more are joined by shuffles.
BROADCAST_ROWS = 200_000
# Shingles are unrolled by explode_outer: for explode, Spark puts a filter on the unrolled list
# below the projections, which would split a text into words once for each of its shingles.
# A text without shingles gives one null, which no join matches.


def _words(text):
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words, make):
    """``make`` of each run of five words; of all words if they are fewer."""
    n = F.size(words)
    return (F.when(n >= WORDS, F.transform(F.sequence(F.lit(1), n - F.lit(WORDS - 1)),
                                           lambda i: make(F.slice(words, i, WORDS))))
            .when(n > 0, F.array(make(words))))


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint behind a count; a large side is left to shuffles."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _items(benchmark, threshold):
    words = benchmark.select("item_id", _words("text").alias("words")).filter("size(words) > 0").distinct()
    sets = words.select("item_id", F.xxhash64("words").alias("body"),
                        F.array_distinct(_shingles(F.col("words"), lambda w: F.concat_ws(" ", w))).alias("shingles"),
                        F.array_sort(F.array_distinct(_shingles(F.col("words"), F.xxhash64))).alias("hashes"))
    sized = sets.withColumn("n", F.size("shingles"))
    least = F.ceil(F.col("n") * threshold - 1e-9)
    sized = sized.withColumn("least", least).withColumn("class_end", F.pow(2, F.ceil(F.log2("n"))))
    spare = F.floor(F.col("class_end") * (1 - threshold) + 1e-9) + 1 + SPARE
    k = F.least(spare, F.col("n")).cast("int")
    return (sized.withColumn("sketch", F.slice("hashes", 1, k))
            .withColumn("need", F.greatest(k - (F.col("n") - F.col("least")), F.lit(1))))


def contained_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, matched, item_shingles, containment (at least the threshold)."""
    spark = docs.sparkSession
    items = checkpointed(spark, _items(benchmark, threshold))
    sketch = items.select("item_id", "body", "need", F.explode("sketch").alias("hash"))
    full = items.select("item_id", "body", "n", F.explode("shingles").alias("shingle"))
    rows = full.count()
    words = docs.select("doc_id", _words("text").alias("words"))
    probes = words.select("doc_id", F.explode_outer(_shingles(F.col("words"), F.xxhash64)).alias("hash"))
    hits = (probes.join(_bounded(sketch, rows), "hash")
            .groupBy("doc_id", "item_id", "body", "hash").agg(F.max("need").alias("need"))
            .groupBy("doc_id", "item_id", "body").agg(F.count("*").alias("hits"), F.max("need").alias("need")))
    found = checkpointed(spark, hits.filter("hits >= need").select("doc_id").distinct())
    ids = _bounded(found.withColumnRenamed("doc_id", "candidate"), found.count())
    held = (words.join(ids, F.col("doc_id").eqNullSafe(F.col("candidate")), "left_semi")
            .select("doc_id", F.explode_outer(_shingles(F.col("words"), lambda w: F.concat_ws(" ", w))).alias("shingle")))
    matched = (held.join(_bounded(full, rows), "shingle")
               .groupBy("doc_id", "item_id", "body", "shingle").agg(F.max("n").alias("n"))
               .groupBy("doc_id", "item_id", "body").agg(F.count("*").alias("matched"), F.max("n").alias("n")))
    best = (matched.withColumn("containment", F.col("matched") / F.col("n"))
            .filter(F.col("containment") >= threshold)
            .groupBy("doc_id", "item_id")
            .agg(F.max(F.struct("containment", "matched", F.col("n").alias("item_shingles"))).alias("best")))
    return best.select("doc_id", "item_id", "best.matched", F.col("best.item_shingles").cast("long")
                       .alias("item_shingles"), "best.containment")


def without_items(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    found = checkpointed(docs.sparkSession, contained_items(docs, benchmark, threshold)
                         .select(F.col("doc_id").alias("item_holder")).distinct())
    ids = _bounded(found, found.count())
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["item_holder"]), "left_anti")


_SQL_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')"
_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS item_shingles FROM bs GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, matched, item_shingles, matched / item_shingles AS containment
FROM m JOIN n USING (item_id) WHERE matched / item_shingles >= {THRESHOLD}"""


@query("op10_minhash_containment", _SQL)
def op10(spark, folder):
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
