import math
import random

import numpy as np
import pytest

from wardlight.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, size int, row string, block long, score long, anchor long"
TOP = np.iinfo(np.int64).max


def brute(rows, every=50, positives=5, count=3, least=50, most=95):
    good = [(n, i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v, label) in enumerate(rows)
            if label is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, label, q in good:
        if i is None or i % every:
            continue
        near = sorted((-min(max(sum(a * b for a, b in zip(q, d)), -TOP), TOP), j is None, j or 0, other == label)
                      for m, j, other, d in good if m != n and len(d) == len(q))
        for s, none, j, _ in [x for x in near if x[3]][:positives]:
            inside = [x for x in near if not x[3] and least * -s <= 100 * -x[0] <= most * -s][:count]
            out += [(i, None if none else j, r, None if x[1] else x[2], -s, -x[0]) for r, x in enumerate(inside, 1)]
    return sorted(out, key=str)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, label, 1, "r", 3, 4, 5) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, negatives.hard_negatives(frame, **options).collect()), key=str)


@pytest.mark.parametrize("blocks", [(4096, 512), (60, 4)])
def test_like_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(0, 0.2, 8)).astype(np.float32).tolist(), i % 5) for i in range(600)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(300)]          # a third are copies
    rows += [(50, rows[3][1], 0), (50, rows[3][1], None), (None, rows[5][1], 0), (None, rows[5][1], 1), (2000, None, 0), (2050, [], 0),
             (2100, [0.5, float("nan")], 0), (2150, [None, 1.0], 0), (2200, [0.5, 0.25], 0), (2201, [0.5, 0.25], 0), (2202, [0.5, 0.2], 1),
             (2250, [0.0] * 8, 0), (-50, rows[9][1], 2), (2300, [float("inf")] * 8, 1)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, every=25, positives=2, negatives=7, least=0, most=100) == brute(rows, 25, 2, 7, 0, 100)


def test_small_empty_and_huge_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0], 1)]) == []
    assert found(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    huge = [(0, [3e38, 1.0], 0), (1, [3e38, 1.0], 0), (2, [1e38, 1e9], 1), (50, [123.5, 7.5], 1), (3, [120.5, 7.5], 1), (4, [80.0, 7.5], 0)]
    assert found(spark, huge) == brute(huge)
    ties = [(i, [1.0 - (i % 3) / 4], i % 2) for i in range(60)]
    assert found(spark, ties) == brute(ties)
    with pytest.raises(ValueError):
        found(spark, ties, least=60, most=50)


def test_zero_scores_and_any_order_of_ids():
    """A window of score 0 takes negatives that come before its positive."""
    rng = random.Random(2)
    for _ in range(300):
        pairs = [(rng.randint(-3, 4), rng.randint(0, 9), rng.random() < 0.5) for _ in range(12)]
        keyed = sorted((negatives.pack_key(7, s, i, n), (70, p)) for n, (s, i, p) in enumerate(pairs))
        ordered = [(*negatives.unpack_key(k)[1:], v[1]) for k, v in keyed]
        want = []
        for s, i, p in [o for o in ordered if o[2]][:2]:
            inside = [o for o in ordered if not o[2] and 50 * s <= 100 * o[0] <= 95 * s][:3]
            want += [(70, i, r, o[1], s, o[0]) for r, o in enumerate(inside, 1)]
        assert sorted(negatives.mine(iter(keyed), 2, 3)) == sorted(want)


def test_keys_sort_by_anchor_descending_score_and_id():
    rng = random.Random(4)
    rows = [(rng.randint(0, 3), rng.choice([-TOP, -5, 0, 7, TOP]), rng.choice([-TOP - 1, -2, 0, 9, TOP]), rng.randint(0, 2)) for _ in range(200)]
    keys = sorted(negatives.pack_key(*r) for r in rows)
    assert [negatives.unpack_key(k) for k in keys] == [r[:3] for r in sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))]
