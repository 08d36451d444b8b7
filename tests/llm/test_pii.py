import hashlib
import random
import re

from tests.llm.rows import ODD, SCHEMA, documents
from wardlight.llm import pii

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def right(kind, match):
    digits = [int(c) for c in match if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        doubled = [(2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(digits[::-1])]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return True


def base(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PATTERNS)
                  for m in re.finditer(p, text or "") if right(kind, m.group()))


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_spans_of_odd_and_random_texts(spark):
    rng = random.Random(4)
    pieces = ["a@b.co", "@", ".", "1.2.3.4", "256.1.1.1", "0001.2.3.004", "4111111111111111", "4111 1111 1111 1111",
              "4111-1111-1111-1112", "+1 (234) 555-6789", "+", "(", " ", "-", "é", "😀", "x_y", "12", "5", "%", "\n", "a@b@c.d.e"]
    texts = [*ODD, *[(100 + i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))) for i in range(600)],
             (20, "1 " * 30_000 + "a@" + "b." * 20_000 + "c"), (21, "7" * 100_000), (22, "+1" + " " * 50_000)]
    rows = pii.found_spans(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, t)
    for r in rows:
        spans = base(by_id[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(shown(spans).encode()).hexdigest(), by_id[r["doc_id"]][:200]
        everything = [x for x in r["spans"].split(",") if x]
        assert set(shown(spans).split(",")) - {""} <= set(everything)
        assert len(everything) == len(spans) + r["n_added"]
    assert pii.found_spans(documents(spark, [])).collect() == []


def test_secrets_are_added_and_clean_texts_left_alone(spark):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    texts = [(i, f'wort und token = "{h}" ende') for i, h in enumerate(hexes)]
    texts += [(100 + i, f"plain words number {i} version 3.0 of 2020") for i in range(60)]
    texts += [(200 + i, f"mail x{i}@mail.example.com now, 10.0.0.{i}") for i in range(60)]
    rows = {r["doc_id"]: r for r in pii.found_spans(documents(spark, texts)).collect()}
    for i in range(60):                                 # one holds digits that pass as a card's
        at = texts[i][1].index(hexes[i])
        assert f"secret:{at}:{at + 40}" in rows[i]["spans"].split(",")
    assert all(rows[i]["spans"] == "" for i in range(100, 160))
    frame = documents(spark, texts + ODD)
    clean = pii.redacted(frame)
    assert clean.schema == SCHEMA
    found = {r["doc_id"]: r for r in clean.collect()}
    assert found[3]["text"] == 'wort und token = "[SECRET]" ende' or found[3]["text"].isspace()
    assert found[207]["text"] == "mail [EMAIL] now, [IP]" and found[207]["n_chars"] == len("mail [EMAIL] now, [IP]")
    assert found[130]["text"] == texts[90][1] and clean.count() == len(texts) + len(ODD)


def test_running_sums_by_blocks(spark):
    from pyspark.sql import functions as F
    for n in (1, 63, 64, 65, 256, 1000):
        got = spark.range(1).select(pii._running(F.array(*[F.lit(i % 7) for i in range(n)])).alias("x")).first()["x"]
        assert got == [sum(i % 7 for i in range(m + 1)) for m in range(n)]


def overlap(a, b):
    return a["s"] < b["e"] and b["s"] < a["e"]


def added_plainly(candidates, spans, model):
    """Every candidate against every span, in plain Python."""
    bias, trees, thresholds = model
    kept = []
    for c in candidates:
        held = any(overlap(b, c) and not (c["gen"] == 3 and c["s"] <= b["s"] and b["e"] <= c["e"]
                                          and b["e"] - b["s"] < c["e"] - c["s"]) for b in spans)
        score = bias + sum(pii._value(t, c) for t in trees)
        if not held and c["gen"] in thresholds and score >= thresholds[c["gen"]]:
            kept.append((-score, c["s"], -c["e"], c["gen"]))
    return {(s, -e) for score, s, e, gen in kept
            if not any(s < -y and x < -e and (o, x, y, g) < (score, s, e, gen) for o, x, y, g in kept)}


def redacted_plainly(text, spans):
    out, at = [], 0
    for s, kind, e in sorted(spans):
        if s >= at:
            out += [text[at:s], f"[{pii.ADDED[kind].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def test_overlaps_and_redaction_equal_plain_ones(spark):
    from pyspark.sql import functions as F
    rng = random.Random(7)
    pieces = ["a@b.co", "x (at) y (dot) com", "1.2.3.4", "1.2.3.400", "4111111111111111", "4111 1111 1111 1112", "+1 (234) 555-6789",
              "token=1.2.3.4", "0123456789abcdef", "key: a1B2c3D4e5F6g7H8i9", " ", "  ", "-", "😀", "é", ".", ",", "12-34-56-78", "9" * 17]
    texts = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    texts += [(500 + i, "".join(rng.choice(pieces) for _ in range(400))) for i in range(3)]
    found = pii.spans_and_candidates(documents(spark, texts).select("doc_id", "text"))
    bias, trees, _ = pii.fit(pii.cells(found))
    for thresholds in ({g: -99.0 for g in range(4)}, {0: -99.0, 3: bias}, {}):
        model = (bias, trees, thresholds)
        rows = found.select("doc_id", "text", "base", "candidates", pii._added(model).alias("added")).withColumn(
            "spans", F.array_sort(F.transform(F.concat("base", F.transform("added", lambda a: F.struct(a["s"], a["e"], a["kind"]))),
                                              lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e")))))
        n = 0
        for r in rows.select("*", pii._redaction(F.col("text"), F.col("spans")).alias("clean")).collect():
            want = added_plainly(r["candidates"], r["base"], model)
            assert {(a["s"], a["e"]) for a in r["added"]} == want and len(r["added"]) == len(want)
            assert r["clean"] == redacted_plainly(r["text"], [tuple(x) for x in r["spans"]])
            n += len(want)
        assert (n > 50) == (len(thresholds) > 1)


def test_many_spans_in_one_text_take_linear_time(spark):
    import time

    def took(n):
        text = " ".join(f"u{i}@mail{i % 7}.example.com 10.{i % 250}.3.{i % 256}," for i in range(n // 2))
        start = time.time()
        r, = pii.found_spans(documents(spark, [(1, text)])).collect()
        assert [r["n_email"], r["n_ip"], r["n_added"]] == [n // 2, n // 2, 0]
        return time.time() - start
    few = took(2_000)
    assert took(100_000) < 50 * few + 20                # quadratic: 2,500 times
    clean, = pii.redacted(documents(spark, [(1, "a@b.co 10.0.0.1, " * 10_000)])).collect()
    assert clean["text"] == "[EMAIL] [IP], " * 10_000


def test_thresholds_hold_each_pool_and_need_evidence():
    assert pii.threshold([(3.0, 100, 99), (2.0, 100, 95), (1.0, 100, 60)]) == 2.0
    assert pii.threshold([(3.0, 1000, 1000), (1.0, 50, 10)]) == 3.0        # 0.96 together, but not in its own pool
    assert pii.threshold([(3.0, 2, 2)]) is None and pii.threshold([]) is None
    assert pii.fit([]) == (0.0, [], {})


def test_unseen_secret_forms_are_found_and_checksums_left(spark):
    rng = random.Random(3)
    signs = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    secrets = ["".join(rng.choice(signs) for _ in range(32)) for _ in range(50)]
    texts = [(i, f"set password: {s} here") for i, s in enumerate(secrets)]
    texts += [(100 + i, f"mail first.x{i} at me: a.b{i}@mail.example.com now") for i in range(50)]
    texts += [(300 + i, f"api_key={s[:20]}-{s[20:]} end") for i, s in enumerate(secrets[:5])]
    texts += [(400 + i, f"commit: {rng.getrandbits(160):040x} merged, sha256={rng.getrandbits(160):040x}") for i in range(50)]
    rows = {r["doc_id"]: r["spans"] for r in pii.found_spans(documents(spark, texts)).collect()}
    assert sum(rows[i] == f"secret:14:{14 + 32}" for i in range(50)) >= 48
    assert all(rows[300 + i] == "secret:8:41" for i in range(5))
    assert all(rows[400 + i] == "" for i in range(50))
    assert all("email" in rows[100 + i] and rows[100 + i].count(":") == 2 for i in range(50))
