import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from tests.llm.rows import ODD, SCHEMA, documents
from wardlight.llm import decontamination, simhash
from wardlight.llm.components import components


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_fingerprints_and_groups_like_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [(i, t) for i, t in ODD if i is not None and t != ODD[3][1]]
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        texts.append((100 + 3 * i, " ".join(text)))
        text[rng.randrange(len(text))] = "edited"
        texts.append((101 + 3 * i, "\t".join(text)))
        texts.append((102 + 3 * i, " ".join(text).upper()))
    prints = [brute_print(t) for _, t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    group, least = roots(len(texts), near), {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, 10 ** 9), texts[i][0])
    want = sorted((texts[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(texts)))
    assert sorted(map(tuple, simhash.near_duplicates(documents(spark, texts)).collect())) == want
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    frame = documents(spark, texts)
    kept = simhash.one_of_each(frame)
    assert kept.schema == SCHEMA
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.one_of_each(documents(spark, [])).collect() == []
    odd = simhash.one_of_each(documents(spark, ODD), broadcast_rows=0).collect()
    assert sorted(str(r["doc_id"]) for r in odd) == ["-9", "1", "4", "5", "7", "8", "None"]


@pytest.mark.parametrize("seed", range(4))
def test_trees_lose_no_link_of_dense_and_spread_prints(seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False))) for _ in range(900)]
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 63, 300, dtype=np.uint64),
                                       np.array([centres[i % 6] ^ f for i, f in enumerate(flips)])]))
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = roots(len(prints), zip(a.tolist(), b.tolist()))
    assert simhash.linked(prints, np.ones(len(prints), bool), 4).tolist() == want
    tree, pairs = simhash.upper_tree(prints[::3], 9), []
    home = np.zeros(len(prints), int)
    parts = list(simhash.visited(tree, prints, 4))
    for shard, own, _ in parts:
        home[own] = shard
    place = {int(p): i for i, p in enumerate(prints)}
    for shard, own, guests in parts:
        rows = np.concatenate([own, guests[home[guests] < shard]])
        frame = pd.DataFrame({"print": prints[rows].view(np.int64), "own": np.arange(len(rows)) < len(own)})
        found = simhash._links(4)(frame)
        pairs += [(place[int(np.uint64(x & (2 ** 64 - 1)))], place[int(np.uint64(y & (2 ** 64 - 1)))])
                  for x, y in zip(found["a"].tolist(), found["b"].tolist())]
    assert roots(len(prints), pairs) == want and len(pairs) < 6 * len(prints)


def test_components_of_paths_stars_and_no_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_items(docs, items):
    def shingles(text):
        w = re.findall(r"[^\W_]+", (text or "").lower())
        return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    found, by_id = {}, {}
    for i, t in docs:
        by_id.setdefault(i, set()).update(shingles(t))
    for j, t in items:
        q = shingles(t)
        for i, d in by_id.items():
            if q and len(q & d) >= 0.8 * len(q):
                found[i, j] = max(found.get((i, j), 0), len(q & d) / len(q))
    return found


@pytest.mark.parametrize("rows", [200_000, 0])
def test_items_inside_documents_like_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    rng = random.Random(3)
    words = [f"v{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([2, 4, 5, 9, 20, 60])))) for i in range(30)]
    items += [(3, "another text of item three with several more words"), (None, "no id but words enough for it"), (40, ""), (41, None)]
    docs = list(ODD) + [(50, items[0][1]), (51, "No ID, but words ENOUGH for it!"), (4, "x")]
    for i in range(60):
        body = [rng.choice(words) for _ in range(80)]
        item = items[i % 30][1].split()
        if i % 3 and len(item) > 8:
            item[rng.randrange(len(item))] = "changed"
        docs.append((100 + i, " ".join(body + item + body)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in
           decontamination.contained_items(documents(spark, docs), benchmark).collect()}
    want = brute_items(docs, items)
    assert got == want and len(want) > 20
    kept = decontamination.without_items(documents(spark, docs), benchmark)
    assert kept.schema == SCHEMA
    flagged = {i for i, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in flagged)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained_items(documents(spark, docs), empty).collect() == []
    assert decontamination.contained_items(documents(spark, []), benchmark).collect() == []
