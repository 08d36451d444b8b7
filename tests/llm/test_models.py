import random
import zlib

import pytest

from tests.llm.rows import ODD, SCHEMA, documents
from wardlight.llm import language, toxicity


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 0


def test_languages_of_held_out_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = language.predicted_languages(docs).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    tested = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == held(r["doc_id"]) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_languages_of_odd_texts(spark):
    rng = random.Random(5)
    learn = [(1000 + i, " ".join(rng.choice(["sch", "ung", "lich"] if i % 2 else ["tion", "eau", "que"]) for _ in range(40)))
             for i in range(200)]
    frame = documents(spark, ODD + learn, [None] * len(ODD) + ["de" if i % 2 else "fr" for i in range(200)])
    rows = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in language.predicted_languages(frame).collect()}
    assert len(rows) == len(ODD) + 200 - 1
    assert rows[1] == rows[2] == rows[3] == rows[8] == ("und", 0.0)
    assert all(rows[1000 + i][0] == ("de" if i % 2 else "fr") for i in range(200))
    kept = language.with_language(frame, 0.3)
    assert kept.schema == SCHEMA
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        [str(i) for i, t in ODD if rows[i][0] != "und"] + [str(i) for i, _ in learn])
    nothing = documents(spark, ODD, [None] * len(ODD))
    assert {r["lang_pred"] for r in language.predicted_languages(nothing).collect()} == {"und"}
    assert language.predicted_languages(documents(spark, [])).collect() == []


def test_windows_hold_the_whole_text():
    for n in (0, 1, 255, 256, 257, 5000):
        assert language.windows("x" * n).tobytes().rstrip(b"\0") == b"x" * n


def test_segments_are_the_maximal_ones():
    def brute(scores, at=0):
        best = None
        for i in range(len(scores)):
            for j in range(i, len(scores)):
                total = sum(scores[i:j + 1])
                if total > 1e-9 and (best is None or total > best[0] + 1e-9 or (abs(total - best[0]) < 1e-9 and j - i < best[2] - best[1])):
                    best = (total, i, j)
        if best is None:
            return []
        total, i, j = best
        return brute(scores[:i], at) + [(at + i, at + j, total)] + brute(scores[j + 1:], at + j + 1)
    for seed in range(60):
        rng = random.Random(seed)
        hits = sorted({rng.randrange(40): rng.choice([0.31, 0.57, 1.13, 2.71]) for _ in range(rng.randrange(0, 14))}.items())
        scores = [-0.29] * 45
        for i, s in hits:
            scores[i] = s
        got = toxicity.segments(hits, cost=0.29)
        want = brute(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_toxicity_of_held_out_documents(spark):
    rng = random.Random(6)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(400)]
    texts, labels = [], []
    for i in range(900):
        body = [rng.choice(words) for _ in range(rng.randrange(20, 200))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                body[rng.randrange(len(body))] = "badstem" + rng.choice("abcdefgh")
        texts.append((i, " ".join(body)))
        labels.append((i, 1, int(toxic)))
    frame = documents(spark, texts + [(5000 + i if i else None, t) for i, t in ODD])
    known = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), (7, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.scored_toxicity(frame, known).collect()
    assert len(rows) == len(texts) + len(ODD)
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    tested = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 6 == 0) for r in tested) >= 0.95 * len(tested)
    odd = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] is None or r["doc_id"] >= 5000}
    assert set(odd.values()) == {min(r["score"] for r in rows)}
    shown = next(r for r in tested if r["predicted"])
    text = texts[shown["doc_id"]][1]
    assert all("badstem" in text[int(a):int(b)] for a, b in (p.split(":") for p in shown["passages"].split(",")))
    none = toxicity.scored_toxicity(frame, known.limit(0)).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.scored_toxicity(documents(spark, []), known).collect() == []
