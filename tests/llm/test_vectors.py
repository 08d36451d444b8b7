import math

import numpy as np
import pytest

from wardlight.llm import covertree

SCHEMA = "vec_id long, embedding array<float>, label int, size int, near long, row string, block long"


def brute(rows, k=5, every=50):
    good = [(i, n, [math.floor(256 * float(np.float32(x))) for x in v]) for n, (i, v) in enumerate(rows)
            if v and all(x is not None and math.isfinite(x) for x in v)]
    top = np.iinfo(np.int64)
    out = []
    for i, n, q in good:
        if i is not None and i % every == 0:
            scored = [(-min(max(sum(a * b for a, b in zip(q, d)), top.min), top.max), j is None, j or 0) for j, m, d in good
                      if m != n and len(d) == len(q)]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, rows, **sizes):
    frame = spark.createDataFrame([(i, v, 0, 1, 2, "r", 3) for i, v in rows], SCHEMA)
    return sorted(map(tuple, covertree.top_k(frame).collect()), key=str)


@pytest.mark.parametrize("block", [4096, 100])
def test_top_k_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "DATA_BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", max(5, block // 20))
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 0.3, (8, 16))
    rows = [(i, (centres[i % 8] + rng.normal(0, 0.1, 16)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(1000 + i, rows[0][1]) for i in range(300)]                 # a third are copies
    rows += [(50, rows[3][1]), (50, rows[3][1]), (None, rows[5][1]), (2000, None), (2001, []), (2050, [0.5, float("nan")]),
             (2003, [None, 1.0]), (2100, [0.5, 0.25]), (2004, [-0.5, 1.0]), (2150, [float("inf")] * 16), (2200, [0.0] * 16), (-50, rows[9][1])]
    assert found(spark, rows) == brute(rows)


def test_small_empty_and_huge_tables(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0, 2.0])]) == []
    huge = [(0, [3e38, -3e38]), (1, [3e38, 1.0]), (2, [1e9, 1e9]), (50, [123456.789, 7.5])]
    assert found(spark, huge) == brute(huge)
    ties = [(i, [1.0]) for i in range(60)]
    assert found(spark, ties) == brute(ties)


def test_cover_tree_radii_hold_and_points_are_whole():
    rng = np.random.default_rng(2)
    for points in (rng.normal(0, 50, (3000, 8)), np.ones((500, 4)), np.repeat(rng.normal(0, 9, (7, 3)), 90, axis=0)):
        tree = covertree.CoverTree(points)
        assert sorted(tree.order) == list(range(len(points)))
        for node, (a, b) in enumerate(tree.span):
            far = np.sqrt(((points[tree.order[a:b]] - tree.centre[node]) ** 2).sum(axis=1)).max()
            assert far <= tree.radius[node] + 1e-9
            if tree.children[node]:
                assert sorted(tree.span[c] for c in tree.children[node])[0][0] == a
                assert sum(tree.span[c][1] - tree.span[c][0] for c in tree.children[node]) == b - a
