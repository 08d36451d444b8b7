import hashlib
import random
import zlib

import pytest

from wardlight.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth long, stack string, first long, n long"


def turn_order(row):
    role, text = row[2] or "", row[3] or ""
    mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:31]
    return row[1] is not None, row[1] or 0, mark


def paths_of(rows):
    out = {}
    for row in sorted((r for r in rows if r[0] is not None), key=turn_order):
        out.setdefault(row[0], []).append((row[2] or "", row[3] or ""))
    return out


def rebuilt(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = paths.get(base, [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for path in nodes:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids.get(path, ())) or 1
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[k] for k in kids.get(path, ()))
    out = []
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids.get(path, ())),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "s", 2, 3) for r in rows], SCHEMA)


def found(spark, rows, more=None):
    return sorted(map(tuple, trie.prefix_trie(frame(spark, rows), more).collect()), key=str)


ODD = [(1, 0, "user", "hi"), (1, 1, "bot", None), (1, 2, None, ""), (2, 0, "user", "hi"), (2, 0, "user", "hi"), (2, None, "system", "é" * 9),
       (3, None, "user", "hi"), (3, None, "user", "other"), (3, 5, "", ""), (None, 0, "user", "hi"), (None, 1, "a", "b"), (4, -1, "user", "hi"),
       (4, 7, "bot", "x" * 100_000), (-6, 0, "user", "hi"), (-6, 1, "bot", ""), (7, 0, "us", "erhi"), (8, 0, "user", "hi"), (8, 1, "bot", None)]


def test_odd_rows_like_brute_force(spark):
    more = spark.createDataFrame([(1,), (90,), (91,), (None,)], "conv_id long")
    assert found(spark, ODD, more) == brute(paths_of(ODD) | {90: [], 91: []})
    assert found(spark, ODD) == brute(paths_of(ODD))


def test_empty_tables(spark):
    assert found(spark, []) == []
    nobody = spark.createDataFrame([(5,), (3,), (3,)], "conv_id long")
    assert found(spark, [], nobody) == brute({3: [], 5: []})


@pytest.mark.parametrize("salts", [64, 2])
def test_shared_starts_copies_and_one_conversation_with_a_third_of_all_rows(spark, monkeypatch, salts):
    monkeypatch.setattr(trie, "SALTS", salts)
    monkeypatch.setattr(trie, "SLICE_BITS", 5)
    monkeypatch.setattr(trie, "ID_BITS", 3)
    rng = random.Random(salts)
    rows = [(0, i, "user", f"long {i}") for i in range(900)]             # spans the range partitions
    rows += [(1, i, "user", f"long {i}" if i < 700 else f"own {i}") for i in range(720)]
    for c in range(2, 200):
        rows += [(c, i, "user", "start" if i < 2 else rng.choice("abc")) for i in range(rng.randint(1, 7))]
    for c in range(200, 260):
        rows += [(c, i, "bot", f"copy {i}") for i in range(4)]
    rows += [(300 + c, i, "bot", f"stair {i}") for c in range(9) for i in range(c)]
    assert found(spark, rows) == brute(paths_of(rows))


def test_rebuilt_conversations_like_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, i, "user", rng.choice("ab")) for c in range(-12, 60) if c % 7 for i in range(rng.randint(1, 12))] + ODD
    placed = trie.walked(trie.marked(frame(spark, rows))).select("conv_id", "depth", "mark", "bytes")
    ids = placed.select("conv_id").distinct()
    got = trie.trie_of(trie.walked(trie.with_shared_heads(placed, ids)), ids)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(paths_of(rows)))


def test_keys_can_be_continued_anywhere():
    marks = [hashlib.sha256(str(i).encode()).hexdigest()[:31] for i in range(9)]
    def key(some):
        k = 0
        for m in some:
            k = (k * trie.BASE + int(m, 16)) % trie.PRIME
        return k.to_bytes(16, "big")
    assert all(trie.joined_key(key(marks[:i]), key(marks[i:]), 9 - i) == key(marks) for i in range(10))
