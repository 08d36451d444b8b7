import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tests.llm.rows import ODD, documents
from wardlight.llm import packing, wavelet
from wardlight.llm.tokens import FILE, Encoder

LIBRARY = Tokenizer.from_file(public_tokenizers.path(FILE))
OWN = Encoder(public_tokenizers.path(FILE), most=500)


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text("abzAZéÉßö's.,!<|> \n\t09", max_size=40)))
def test_ids_are_the_library_s(text):
    assert np.frombuffer(OWN.encode(text), "<u4").tolist() == ids(text)


def test_other_tokenizer_files_go_through_the_library():
    own = Encoder(public_tokenizers.path(FILE))
    own.plain = False
    assert own.encode("It's THE\nend 42.") == OWN.encode("It's THE\nend 42.")


def check_pieces(rows, texts, top=2048):
    by_row, by_sequence = {}, {}
    for r in rows:
        by_row.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, expected in texts.items():
        got = sorted(by_row.pop(doc_id), key=lambda r: r["start"])
        whole = [np.array(ids(t) + [1], "<u4") for t in expected]
        if len(expected) > 1:
            assert sum(r["length"] for r in got) == sum(map(len, whole))
            continue
        assert [r["start"] for r in got] == [0, *np.cumsum([r["length"] for r in got])[:-1]]
        assert sum(r["length"] for r in got) == len(whole[0]) == got[0]["doc_tokens"]
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(whole[0][r["start"]:r["start"] + r["length"]].tobytes())
    assert not by_row
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == [0, *np.cumsum([r["length"] for r in pieces])[:-1]]
        size = sum(r["length"] for r in pieces)
        assert size <= top and size & (size - 1) == 0 and {r["tier"] for r in pieces} == {size}
    groups = {}
    for r in rows:
        groups[r["step_group"]] = groups.get(r["step_group"], 0) + r["length"]
    assert max(groups.values(), default=0) <= packing.STEP_TOKENS


def test_odd_documents_are_packed_whole(spark):
    texts = {}
    for i, t in ODD:
        texts.setdefault(i, []).append(t)
    frame = packing.packed_sequences(documents(spark, ODD))
    rows = frame.collect()
    check_pieces(rows, texts)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, frame.collect()), key=str)
    assert packing.packed_sequences(documents(spark, [])).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_packer_fills_every_window(seed):
    rng, packer = random.Random(seed), packing.Packer(partition=3, waiting=8)
    want = {}
    for i in range(400):
        want[i] = np.array([i] * rng.choice([1, 5, 255, 256, 257, rng.randrange(1, 5000)]), "<u4")
        packer.add(i, want[i].tobytes())
    packer.finish()
    rows = packer.taken()
    sizes, lengths = {}, {}
    for doc_id, _, length, _, _, sequence, offset, tier, group in rows:
        sizes[sequence] = sizes.get(sequence, 0) + length
        lengths[doc_id] = lengths.get(doc_id, 0) + length
        assert sequence >= 3 * packing.PART and group >= 3 * packing.PART
    assert lengths == {i: len(x) for i, x in want.items()}
    assert all(s & (s - 1) == 0 for s in sizes.values())
    assert sum(s in packing.TIERS for s in sizes.values()) >= len(sizes) - 11


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 49_407), (70_000, 3), (140_001, 49_407), (5_000, 1 << 20)])
def test_wavelet_file_answers_like_the_list(n, top):
    rng = np.random.default_rng(n)
    ids_ = rng.integers(0, top, n).astype("<u4")
    content = wavelet.build(ids_, np.array([0, n]))
    file = wavelet.Wavelet(lambda at, size: content[at:at + size])
    assert (file.all_ids() == ids_).all() and len(file.all_ids()) == n
    for at in rng.integers(0, n, 20).tolist() if n else []:
        token = int(ids_[at])
        where = np.flatnonzero(ids_ == token)
        assert file.access(at) == token
        assert file.rank(token, at) == (ids_[:at] == token).sum() and file.rank(token, n) == len(where)
        k = int(np.searchsorted(where, at))
        assert file.select(token, k) == at and file.select(token, len(where)) is None
    assert file.rank(1 << 25, n) == 0 and file.select(1 << 25, 0) is None


def test_documents_come_back_from_files(spark):
    frame = documents(spark, ODD)
    rows = wavelet.read_documents(wavelet.write_shards(frame, shard_tokens=20_000)).collect()
    want, at = [], 0
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, t in order:
        x = np.array(ids(t) + [2], "<u4")
        want.append((i, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    assert wavelet.read_documents(wavelet.write_shards(documents(spark, []))).collect() == []
