"""Language identification by a byte convolutional network, trained in numpy.

A text is cut into windows of ``WINDOW`` bytes (UTF-8, ASCII letters lower-cased, the
last one padded with zeros).  Filters of several widths run over a window's one-hot
bytes, so a convolution is a sum of rows of weight tables; each filter's largest value
and a softmax layer give the window's language probabilities, and a text's are the mean
over all its windows.  Two weight tables are added up beforehand for all pairs of bytes.

The network is fitted on a bounded sample: about ``DOCS_PER_LANG`` documents of each
language, chosen by a hash of the id, ``WINDOWS_PER_DOC`` windows spread over each.

Defined results: ``und`` with score 0 for null and empty texts, those without a letter,
and all texts if there is nothing to learn from; ties go to the first language in
alphabetical order; equal rows give equal rows; an empty table gives no rows; other
columns are not read for a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wardlight.llm.tables import held_out, query, share_of, table, texts

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
DOCS_PER_LANG, WINDOWS_PER_DOC = 500, 6
STEPS, BATCH = 400, 64
PRIOR, HELD_OUT_DOCS = 64, 4000
#: Bits below the held-out documents' likeness that are still of the language: few documents show few odd ones.
MARGIN = 1.0
UNKNOWN = "und"


def windows(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    out = np.zeros((max(1, -(-len(data) // WINDOW)), WINDOW), np.uint8)
    out.reshape(-1)[:len(data)] = data
    return out


class Network:
    """Weights: for each width a table (width, 256, filters), and a softmax layer."""

    def __init__(self, langs, conv, dense, bias):
        self.langs, self.conv, self.dense, self.bias = langs, conv, dense, bias
        self._tables = None

    def _parts(self):
        """Per width the tables to add: (pairs?, first byte, rows)."""
        if self._tables is None:
            self._tables = []
            for w in self.conv:
                k, parts = len(w), []
                for j in range(0, k - 1, 2):
                    parts.append((True, j, (w[j][:, None] + w[j + 1][None]).reshape(65_536, -1)))
                if k % 2:
                    parts.append((False, k - 1, w[k - 1]))
                self._tables.append((k, parts))
        return self._tables

    def probabilities(self, wins: np.ndarray) -> np.ndarray:
        """Of each window and language."""
        out = []
        for at in range(0, len(wins), 64):
            single = wins[at:at + 64].astype(np.int64)
            pair, pooled = single[:, :-1] * 256 + single[:, 1:], []
            for k, parts in self._parts():
                n, total = WINDOW - k + 1, None
                for pairs, j, rows in parts:
                    found = rows.take((pair if pairs else single)[:, j:j + n], axis=0)
                    total = found if total is None else np.add(total, found, out=total)
                pooled.append(total.max(axis=1))
            out.append(_softmax(np.maximum(np.concatenate(pooled, axis=1), 0) @ self.dense + self.bias))
        return np.concatenate(out)


def _softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(wins: np.ndarray, langs: list[str]) -> Network:
    """Adam on the log loss; windows are cut at random places to learn short texts too."""
    names = sorted(set(langs))
    target = np.searchsorted(names, langs)
    rng = np.random.default_rng(3)
    order = np.concatenate([np.flatnonzero(target == c) for c in range(len(names))])
    wins, target = wins[order], target[order]
    first = np.searchsorted(target, range(len(names) + 1))
    conv = [rng.normal(0, 0.3 / k ** 0.5, (k, 256, FILTERS)).astype(np.float32) for k in WIDTHS]
    width = FILTERS * len(WIDTHS)
    dense, bias = rng.normal(0, width ** -0.5, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    weights = [*conv, dense, bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        c = rng.integers(len(names), size=BATCH)                        # languages count alike
        x = wins[first[c] + rng.integers(1 << 31, size=BATCH) % (first[c + 1] - first[c])].astype(np.int64)
        short = rng.random(BATCH) < 0.5
        x[short[:, None] & (np.arange(WINDOW) >= rng.integers(12, WINDOW, BATCH)[:, None])] = 0
        pooled, places = [], []
        for w in conv:
            k, n = len(w), WINDOW - len(w) + 1
            total = sum(w[j].take(x[:, j:j + n], axis=0) for j in range(k))
            at = total.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
        pool = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pool, 0)
        slope = _softmax(hidden @ dense + bias)
        slope[np.arange(BATCH), c] -= 1
        slope /= BATCH
        back = (slope @ dense.T) * (pool > 0)
        slopes = []
        for i, w in enumerate(conv):
            g, part = np.zeros_like(w), back[:, i * FILTERS:(i + 1) * FILTERS]
            for j in range(len(w)):
                np.add.at(g[j], (np.take_along_axis(x, places[i] + j, axis=1), np.arange(FILTERS)[None]), part)
            slopes.append(g)
        slopes += [hidden.T @ slope, slope.sum(axis=0)]
        rate = 0.02 * min(1, 2 * (1 - step / (STEPS + 1)))
        for w, g, m, s in zip(weights, slopes, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Network(names, conv, dense, bias)


def _sampled(batches):
    for batch in batches:
        langs, rows = [], []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            wins = windows(text.as_py())
            at = np.unique(np.linspace(0, len(wins) - 1, WINDOWS_PER_DOC).astype(int))
            langs += [lang] * len(at)
            rows += [w.tobytes() for w in wins[at]]
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.binary())], ["lang", "win"])


def _learnt(docs: DataFrame):
    """(windows, langs) of documents that are not held out; None if none has a lang."""
    known = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = sorted(docs.filter(~held_out() & F.col("lang").isNotNull()).groupBy("lang").count().collect())
    chosen = F.lit(False)
    for lang, n in counts:
        chosen = chosen | ((F.col("lang") == lang) & share_of(DOCS_PER_LANG, n, "doc_id"))
    some = known.filter(chosen).select("lang", "text").limit(2 * DOCS_PER_LANG * max(1, len(counts)))
    rows = some.mapInArrow(_sampled, "lang string, win binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["win"])) for r in rows)
    wins = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    return wins, [lang for lang, _ in rows]


def fitted(docs: DataFrame) -> Network | None:
    """From text and lang of documents that are not held out; None if none has a lang."""
    found = _learnt(docs)
    return train(*found) if found else None


class Likeness:
    """How usual a text's pairs of bytes are in a language: mean log2 probability against the
    language's own mean, drawn to it by ``PRIOR`` usual pairs, so short texts differ little."""

    def __init__(self, wins: np.ndarray, langs: list[str]):
        self.names, langs = sorted(set(langs)), np.array(langs)
        self.tables, self.means = [], []
        for name in self.names:
            pair = self._pairs(wins[langs == name])
            n = np.bincount(pair, minlength=65_536).reshape(256, 256)
            logs = np.log2((n + 0.1) / (n.sum(axis=1, keepdims=True) + 25.6)).ravel()
            self.tables.append(logs)
            self.means.append(float(logs[pair].mean()) if len(pair) else 0.0)

    @staticmethod
    def _pairs(wins):
        wins = wins.astype(np.int64)
        return (wins[:, :-1] * 256 + wins[:, 1:])[wins[:, 1:] != 0]

    def of(self, text: str, lang: str) -> float:
        i, pair = self.names.index(lang), self._pairs(windows(text))
        return float((self.tables[i][pair] - self.means[i]).sum() / (len(pair) + PRIOR))


def language_of(network: Network | None, texts_: list[str]) -> list[tuple[str, float]]:
    """Windows of all texts run through the network together, in bounded batches."""
    out = [(UNKNOWN, 0.0)] * len(texts_)
    if network is None:
        return out
    todo = [i for i, t in enumerate(texts_) if any(map(str.isalpha, t))]
    while todo:
        some, size = [], 0
        while todo and size < 4096:
            wins = windows(texts_[todo[-1]])
            some.append((todo.pop(), wins))
            size += len(wins)
        p = network.probabilities(np.concatenate([w for _, w in some]))
        at = 0
        for i, wins in some:
            mean = p[at:at + len(wins)].mean(axis=0, dtype=np.float64)
            best = int(mean.argmax())
            out[i], at = (network.langs[best], min(1.0, float(mean[best]))), at + len(wins)
    return out


def _predicted(network):
    def predict(batches):
        for batch in batches:
            found = language_of(network, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()),
                 pa.array([x[1] for x in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
    return predict


def predicted_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    rows = texts(docs).select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predicted(fitted(docs)), "doc_id long, held_out boolean, lang_pred string, score double")


def _judged(network, likeness, some: list[str]):
    """(score, likeness) of texts; None for those of no language."""
    return [None if lang == UNKNOWN else (score, likeness.of(t, lang)) for t, (lang, score) in zip(some, language_of(network, some))]


def cuts(docs: DataFrame, network: Network, likeness: Likeness, share: float) -> tuple[float, float]:
    """The score and the likeness that all but 1 - ``share`` of labelled documents reach that
    were not learnt from (the least of them if they are few), the likeness less ``MARGIN``."""
    known = docs.filter(held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    some = known.filter(share_of(HELD_OUT_DOCS, known.count(), "doc_id")).select("text").limit(2 * HELD_OUT_DOCS)

    def judge(batches):
        for batch in batches:
            found = [x for x in _judged(network, likeness, batch.column(0).to_pylist()) if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.float64()) for i in (0, 1)], ["score", "like"])
    rows = some.mapInArrow(judge, "score double, like double").collect()
    if not rows:
        return 0.0, -np.inf
    score, like = (float(np.quantile([r[i] for r in rows], 1 - share, method="lower")) for i in (0, 1))
    return score - 1e-5, like - MARGIN                                  # sums differ in the last bits by batch


def with_language(docs: DataFrame, least: float | None = None, share: float = 0.999) -> DataFrame:
    """The documents, in their own columns, whose language is known: with the least score, or,
    if none is given, with the score and likeness of ``share`` of the held-out documents."""
    learnt, names = _learnt(docs), docs.columns
    if learnt is None:
        return docs.limit(0)
    network, likeness = train(*learnt), Likeness(*learnt)
    score, like = (least, -np.inf) if least is not None else cuts(docs, network, likeness, share)

    def keep(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            found = _judged(network, likeness, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array([x is not None and x[0] >= score and x[1] >= like for x in found], pa.bool_()))
    return docs.mapInArrow(keep, docs.schema).select(*names)


@query("op5_byte_network")
def op5(spark, folder):
    return predicted_languages(table(spark, folder, "documents"))
