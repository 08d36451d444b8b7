"""Odd tables that every operator must stand."""

from pyspark.sql import types as T

LONG = "wort " * 60_000
#: Columns whose names the operators use themselves.
CLASHING = ["print", "row", "words", "hash", "base", "candidates", "copy", "item_id", "shard", "own", "key", "spans",
            "length", "candidate", "item_holder", "odd_id", "stays", "score", "held_out"]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHING]])


def documents(spark, texts, langs=None):
    """texts: (doc_id, text) pairs."""
    rows = [(i, t, langs[n] if langs else "en", "s", len(t or ""), *CLASHING) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, "  \t\n "), (4, LONG), (5, "same text twice"), (5, "same text twice"), (6, "same text twice"),
       (7, "Ein é Zeichen 漢字 😀 it's <|endoftext|> İ ́a"), (None, "no id here"), (8, "0 1 2 3 4 5 6 7 8 9"), (-9, "a")]
