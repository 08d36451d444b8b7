"""Order-dependent work that stays whole and parallel when one key is huge.

A plain window over a key puts all rows of that key into one task.  Here a key of many
rows is cut into parts of about ``ROWS`` rows: a thin systematic sample of the rows is
counted, and every ``SAMPLES``-th sampled row in a key's order is a split point, whatever
the time between two of them.  Most keys have no split point and stay one part, so
windows run per (key, part) behind one shuffle of the rows; what crosses an edge between
parts is summed part by part, scanned over the parts of its key, and comes back by a
broadcast of at most one row per split point.  Results equal those of the uncut window.

There is one split point for ``ROWS`` rows at most, which bounds both broadcasts (a table
of 10^12 rows has up to a million).  Rows of one key that are equal in all columns of the order
cannot be told apart and stay in one part, so the order should end in an id.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Rows of a part, and sampled rows between two split points.
ROWS, SAMPLES = 1_000_000, 128
PARTED = ("_part", "_hot")


def split_points(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None) -> DataFrame:
    """(keys, ``_points``) of the keys with more than about ``rows`` rows: sorted structs of
    the order's columns; a part begins at each."""
    every = max(1, (rows or ROWS) // SAMPLES)
    thin = (df.select(*keys, F.struct(*order).alias("_at"))
            .where(F.monotonically_increasing_id() % every == 0).groupBy(*keys, "_at").agg(F.count(F.lit(1)).alias("_n")))
    passed = F.sum("_n").over(W.partitionBy(*keys).orderBy("_at"))
    steps = thin.withColumn("_passed", passed).where(
        F.floor(F.col("_passed") / SAMPLES) > F.floor((F.col("_passed") - F.col("_n")) / SAMPLES))
    return steps.groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_points"))


def _part_of(points: Column, at: Column) -> Column:
    """How many points are at or before a row, by halving."""
    def halved(acc, _):
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(points, middle) <= at
        done = acc["lo"] >= acc["hi"]
        return F.struct(F.when(~done & below, middle + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(~done & ~below, middle).otherwise(acc["hi"]).alias("hi"))
    start = F.struct(F.lit(0).alias("lo"), F.size(points).alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(points) + 1)).cast("int") + 1)
    return F.when(points.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halved, lambda acc: acc["lo"]))


def parted(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, points: DataFrame | None = None) -> DataFrame:
    """Adds ``_part``, a row's part of its key, and ``_hot``, whether the key has several.
    Parts follow the order."""
    if points is None:
        points = split_points(df, keys, order, rows)
    return (df.join(F.broadcast(points), keys, "left").withColumn("_part", _part_of(F.col("_points"), F.struct(*order)))
            .withColumn("_hot", F.col("_points").isNotNull()).drop("_points"))


def _cut(df, keys, order, rows):
    """The parted rows, and the columns to drop in the end (none where the caller parted them)."""
    given = "_part" in df.columns
    return (df if given else parted(df, keys, order, rows)), (() if given else PARTED)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "seq", rows: int | None = None) -> DataFrame:
    """1-based position of every row within its key in the given order."""
    cut, spare = _cut(df, keys, order, rows)
    by_part = [*keys, "_part"]
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (cut.where("_hot").groupBy(*by_part).agg(F.count(F.lit(1)).alias("_rows"))
               .withColumn("_before", F.sum("_rows").over(earlier)).drop("_rows"))
    inside = cut.withColumn("_pos", F.row_number().over(W.partitionBy(*by_part).orderBy(*order)))
    out = inside.join(F.broadcast(offsets), by_part, "left")
    return out.withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_pos")).drop("_before", "_pos", *spare)


def day_offsets(cut: DataFrame, keys: list[str], day: Column, counted: Column) -> DataFrame:
    """(keys, ``_part``, ``_first_day``, ``_day_before``) of parted rows: how many counted
    rows of a part's first day are in earlier parts.  Later days of a part begin in it."""
    hits = cut.where("_hot").groupBy(*keys, "_part", day.alias("_first_day")).agg(F.count_if(counted).alias("_hits"))
    earlier = W.partitionBy(*keys, "_first_day").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    first = F.row_number().over(W.partitionBy(*keys, "_part").orderBy("_first_day"))
    return (hits.withColumn("_day_before", F.coalesce(F.sum("_hits").over(earlier), F.lit(0)))
            .withColumn("_spot", first).where("_spot = 1").drop("_hits", "_spot"))


def lent(cut: DataFrame, keys: list[str], order: list[str], rows: int) -> DataFrame:
    """Parted rows with ``_own``, and before each part the last ``rows`` rows of the part
    before it, not owned there; a frame of so many preceding rows is then whole in a part.
    ``SAMPLES`` rows are the least that a part before another has."""
    if rows >= SAMPLES:
        raise ValueError(f"fewer than {SAMPLES} rows can be lent")
    last = top_per(cut.where("_hot"), [*keys, "_part"], [F.desc(o) for o in order], rows)
    return cut.withColumn("_own", F.lit(True)).unionByName(
        last.withColumn("_part", F.col("_part") + 1).withColumn("_own", F.lit(False)))


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: list[str],
                  name: str = "prev", rows: int | None = None) -> DataFrame:
    """Adds a struct of ``values`` of the previous row of the same key (null on
    the first one)."""
    cut, spare = _cut(df, keys, order, rows)
    by_part = [*keys, "_part"]
    body = F.struct(*values)
    last = cut.where("_hot").groupBy(*by_part).agg(F.max_by(body, F.struct(*order)).alias("_last"))
    carried = last.select(*by_part, F.lag("_last").over(W.partitionBy(*keys).orderBy("_part")).alias("_carried"))
    inside = cut.withColumn("_near", F.lag(body).over(W.partitionBy(*by_part).orderBy(*order)))
    return (inside.join(F.broadcast(carried), by_part, "left")
            .withColumn(name, F.coalesce("_near", "_carried")).drop("_near", "_carried", *spare))


def with_latest_mark(df: DataFrame, keys: list[str], order: list[str], mark: str, rows: int | None = None) -> DataFrame:
    """Fills ``mark`` forward: every row gets the newest mark at or before it."""
    cut, spare = _cut(df, keys, order, rows)
    by_part = [*keys, "_part"]
    until_now = W.partitionBy(*by_part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    newest = cut.where("_hot").groupBy(*by_part).agg(F.max(mark).alias("_mark"))
    carried = newest.select(*by_part, F.max("_mark").over(earlier).alias("_carried"))
    inside = cut.withColumn("_near", F.max(mark).over(until_now))
    return (inside.join(F.broadcast(carried), by_part, "left")
            .withColumn(mark, F.coalesce("_near", "_carried")).drop("_near", "_carried", *spare))


def gap_statistics(df: DataFrame, keys: list[str], number: Column, rows: int | None = None) -> DataFrame:
    """Per key: count, mean, minimum, maximum and population deviation of the gaps
    between consecutive values of ``number`` (a time as a number).

    A part has the count, mean and squared deviation of its gaps, an edge between parts is
    one gap more; they are merged by their distances from the key's mean, so long and
    nearly equal gaps lose no digits as a difference of squares would."""
    cut = parted(df.select(*keys, number.alias("_t")), keys, ["_t"], rows)
    by_part = [*keys, "_part"]
    gap = F.col("_t") - F.lag("_t").over(W.partitionBy(*by_part).orderBy("_t"))
    parts = (cut.withColumn("_gap", gap.cast("double")).groupBy(*by_part)
             .agg(F.count("_gap").alias("n"), F.avg("_gap").alias("m"), F.var_pop("_gap").alias("v"),
                  F.min("_gap").alias("lo"), F.max("_gap").alias("hi"),
                  F.min("_t").alias("first"), F.max("_t").alias("last")))
    step = (F.col("first") - F.lag("last").over(W.partitionBy(*keys).orderBy("_part"))).cast("double")
    whole, zero = W.partitionBy(*keys), lambda c: F.coalesce(c, F.lit(0.0))
    edged = parts.withColumn("e", step)
    gaps = F.sum(F.col("n") + F.when(F.col("e").isNotNull(), 1).otherwise(0)).over(whole)
    total = F.sum(zero(F.col("n") * F.col("m")) + zero(F.col("e"))).over(whole)
    apart = edged.withColumns({"gaps": gaps, "mean": F.when(gaps > 0, total / gaps)})
    far = lambda x: (F.col(x) - F.col("mean")) * (F.col(x) - F.col("mean"))
    return apart.groupBy(*keys).agg(
        F.first("gaps").alias("gaps"), F.first("mean").alias("mean_gap"),
        F.min(F.least("lo", "e")).alias("min_gap"), F.max(F.greatest("hi", "e")).alias("max_gap"),
        F.sqrt(F.sum(zero(F.col("n") * (F.col("v") + far("m"))) + zero(far("e"))) / F.nullif(F.first("gaps"), F.lit(0))).alias("std_gap"))


def top_per(df: DataFrame, keys: list[str], order: list, limit: int | None, rank: str | None = None) -> DataFrame:
    """First ``limit`` rows of each key (None: all); Spark cuts each task's rows to the
    limit before the shuffle, so a huge key does not travel whole."""
    if limit is None and rank is None:
        return df
    spot = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("_rank", spot)
    if limit is not None:
        kept = kept.where(F.col("_rank") <= limit)
    return kept.withColumnRenamed("_rank", rank) if rank else kept.drop("_rank")
