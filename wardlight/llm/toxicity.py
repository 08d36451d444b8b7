"""Toxic passages as maximum-scoring segments of token log-odds.

Words and their four- and five-letter beginnings are scored by the log-odds of toxic
against clean documents under a Dirichlet prior of the whole sample's rates, less one standard
error; those whose rates differ clearly, by a likelihood-ratio test, make the lexicon.  A word takes the score of
its longest listed form, and every other word costs ``COST``.  A linear scan finds all
maximal segments of positive score in a text.  Segments are judged by extreme-value
statistics: with ``lam`` from the scores' moment equation and ``k`` fitted to clean
documents, the chance that clean text of the same length has such a segment is
1 - exp(-k n exp(-lam s)).  A passage is significant below ``CHANCE``.  A document's
evidence adds its segments' normalised scores; a logistic curve fitted on the sample
turns it into the score.

The lexicon is fitted on a bounded sample of labelled documents that are not held out
(about ``DOCS_PER_CLASS`` of each label, by a hash of the id); of copies and near copies
in it, found by three min-hashes, only one counts.

Defined results: a text without listed words, an empty or null one has the curve's
lowest score; without labels of both kinds all scores are 0; a document with several
labels is toxic if one says so; equal rows give equal rows; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.tables import held_out, query, share_of, table, texts

DOCS_PER_CLASS = 5_000
#: A listed form's likelihood-ratio statistic and its ratio of rates, at least.
CLEAR, RATIO = 20.0, 4.0
PRIOR, COST, CHANCE = 10.0, 0.08, 0.01
_WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    """The word, and its beginnings that more words may share."""
    return [word, *(f"{word[:n]}-" for n in (5, 4) if len(word) > n)]


class Lexicon:
    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.starts = {f[:4] for f in scores}
        self.lam = self.k = 1.0
        self.slope, self.bias = 1.0, 0.0

    def score(self, word):
        return next((self.scores[f] for f in forms(word) if f in self.scores), None)

    def hits(self, words):
        starts = self.starts
        found = [(i, self.score(w)) for i, w in enumerate(words) if w[:4] in starts]
        return [(i, s) for i, s in found if s is not None]

    def evidence(self, segments, n):
        """Sum of the normalised scores above zero, and the significant segments."""
        if not segments:
            return 0.0, []
        floor = math.log(max(self.k * n, 1e-9))
        bits = [self.lam * s - floor for _, _, s in segments]
        least = -math.log(-math.log1p(-CHANCE))
        return (math.log1p(sum(b for b in bits if b > 0)),
                [seg for seg, b in zip(segments, bits) if b >= least])

    def probability(self, evidence):
        x = self.slope * evidence + self.bias
        return 1 / (1 + math.exp(-x)) if x > -500 else 0.0


def segments(hits: list[tuple[int, float]], cost: float = COST) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first word, last word, score), one pass over the hits.

    Each open segment keeps the running total before and after it.  A new one looks back
    for the nearest with a lower total before it; if that one's total after is lower too,
    both join, else the new one stays (Ruzzo and Tompa)."""
    out, total, last = [], 0.0, -1
    for at, score in hits:
        total -= cost * (at - last - 1)
        last = at
        if score <= 0:
            total += score
            continue
        new = [at, at, total, total + score, None]      # first, last, before, after, nearest with lower before
        total += score
        j = len(out) - 1
        while True:
            while j is not None and j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j is None or j < 0 or out[j][3] >= new[3]:
                break
            new = [out[j][0], new[1], out[j][2], new[3], out[j][4]]
            del out[j:]
            j = new[4]
        new[4] = j
        out.append(new)
    return [(a, b, after - before) for a, b, before, after, _ in out]


def _keys(words):
    """Three min-hashes of the three-word shingles: near copies agree in most."""
    from xxhash import xxh64_intdigest
    shingles = {" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))}
    return [min(xxh64_intdigest(s, seed) for s in shingles) for seed in (1, 2, 3)]


def _ratio(y1, n1, y0, n0):
    """Twice the log of the likelihood ratio of two rates against one common rate."""
    def part(y, n, rate):
        return (y * math.log(y / (n * rate)) if y else 0.0) + ((n - y) * math.log((n - y) / (n * (1 - rate))) if y < n else 0.0)
    rate = (y1 + y0) / (n1 + n0)
    return 2 * (part(y1, n1, rate) + part(y0, n0, rate)) if 0 < rate < 1 else 0.0


def learn(docs: list[tuple[str, int]]) -> Lexicon | None:
    """docs: (text, toxic) of a bounded sample, in a fixed order."""
    rows = [(_WORD.findall(text.lower()), toxic) for text, toxic in docs]
    for i in range(3):
        seen, kept = set(), []
        for words, toxic in rows:
            key = (_keys(words)[i], toxic)
            if key not in seen:
                seen.add(key)
                kept.append((words, toxic))
        rows = kept
    n = Counter(toxic for _, toxic in rows)
    if not (n[0] and n[1]):
        return None
    df = (Counter(), Counter())
    for words, toxic in rows:
        df[toxic].update({f for w in set(words) for f in forms(w)})
    scores = {}
    for form, y1 in df[1].items():
        y0 = df[0][form]
        if y1 < 2:
            continue
        if y1 * n[0] < RATIO * y0 * n[1] or _ratio(y1, n[1], y0, n[0]) < CLEAR:
            continue
        prior = PRIOR * (y1 + y0) / len(rows)
        odds = [math.log((y + prior) / (m + PRIOR - y - prior)) for y, m in ((y1, n[1]), (y0, n[0]))]
        error = math.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))
        if odds[0] - odds[1] > error:
            scores[form] = odds[0] - odds[1] - error
    lexicon = Lexicon(scores)
    _calibrate(lexicon, rows)
    return lexicon


def _calibrate(lexicon, rows):
    clean = Counter()
    found = []
    for words, toxic in rows:
        hits = lexicon.hits(words)
        found.append((segments(hits), max(1, len(words)), toxic))
        if not toxic:
            clean.update(round(s, 1) for _, s in hits)
    n = sum(length for _, length, toxic in found if not toxic)
    rates = {s: k / n for s, k in clean.items()} or {max(lexicon.scores.values(), default=1.0): 0.5 / n}

    def moment(lam):
        return sum(r * math.exp(min(lam * s, 700)) for s, r in rates.items()) + (1 - sum(rates.values())) * math.exp(-lam * COST)
    low, high = 1e-6, 1.0
    while moment(high) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 1 else (low, middle)
    lexicon.lam = low
    best = [(max((s for _, _, s in segs), default=0.0), length) for segs, length, toxic in found if not toxic]
    lexicon.k = (len(best) + 1) / (sum(length * math.exp(-lexicon.lam * s) for s, length in best) + 1)
    points = [(lexicon.evidence(segs, length)[0], toxic) for segs, length, toxic in found]
    slope, bias = 1.0, 0.0
    for _ in range(50):                                 # Newton steps, with a small ridge
        g0 = g1 = h01 = 0.0
        h00 = h11 = 1e-3
        for x, y in points:
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, slope * x + bias))))
            w = p * (1 - p)
            g0, g1 = g0 + y - p, g1 + (y - p) * x
            h00, h01, h11 = h00 + w, h01 + w * x, h11 + w * x * x
        g0, g1 = g0 - 1e-3 * bias, g1 - 1e-3 * slope
        det = h00 * h11 - h01 * h01
        step = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        bias, slope = bias + max(-5, min(5, step[0])), slope + max(-5, min(5, step[1]))
    lexicon.slope, lexicon.bias = slope, bias


def fitted(docs: DataFrame, labels: DataFrame) -> Lexicon | None:
    known = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
             .groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    counts = known.groupBy("toxic").count().collect()
    chosen = F.lit(False)
    for toxic, n in counts:
        chosen = chosen | ((F.col("toxic") == toxic) & share_of(DOCS_PER_CLASS, n, "doc_id"))
    ids = known.filter(chosen).select(F.col("doc_id").alias("known_id"), F.col("toxic").alias("known_toxic"))
    rows = texts(docs).join(F.broadcast(ids), F.col("doc_id") == F.col("known_id"))     # bounded by the parameter
    rows = rows.select("doc_id", "text", "known_toxic").limit(4 * DOCS_PER_CLASS).collect()
    return learn([(r["text"], r["known_toxic"]) for r in sorted(rows)])


def _scored(lexicon):
    def judged(text):
        if lexicon is None:
            return 0.0, ""
        text = text.lower()
        words = _WORD.findall(text)
        hits = lexicon.hits(words)
        evidence, clear = lexicon.evidence(segments(hits), max(1, len(words)))
        if clear:
            places = [m.span() for m in _WORD.finditer(text)]
            clear = [f"{places[a][0]}:{places[b][1]}" for a, b, _ in clear]
        return lexicon.probability(evidence), ",".join(clear)

    def score(batches):
        for batch in batches:
            found = [judged(t.as_py()) for t in batch.column(2)]
            scores = [s for s, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([p for _, p in found], pa.string())],
                ["doc_id", "held_out", "score", "predicted", "passages"])
    return score


def scored_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (start:end in the lower-cased text)."""
    rows = texts(docs).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_scored(fitted(docs, labels)),
                           "doc_id long, held_out boolean, score double, predicted int, passages string")


@query("op6_toxic_segments")
def op6(spark, folder):
    return scored_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
