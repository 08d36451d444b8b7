import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from tests.llm import rows
from wardlight.llm import bpe
from wardlight.llm.tables import file_path
from wardlight.llm.tokens import FILE


@pytest.fixture(scope="module")
def pair():
    return bpe.bpe(file_path(FILE)), Tokenizer.from_file(file_path(FILE))


def ids(library, text):
    return array("I", library.encode(text, add_special_tokens=False).ids).tobytes()


def plain_merges(merges, symbols):
    """Lowest rank first, leftmost among equals."""
    while True:
        ranks = [merges.rank.get(a * merges.size + b, bpe._NEVER) for a, b in zip(symbols, symbols[1:])]
        if not ranks or min(ranks) == bpe._NEVER:
            return symbols
        at = ranks.index(min(ranks))
        made = next(i for i in range(merges.size) if merges.born[i] == ranks[at])
        symbols = [*symbols[:at], made, *symbols[at + 2:]]


def test_like_the_library_on_random_texts(pair):
    ours, library = pair
    rng = random.Random(3)
    words = [w.replace("</w>", "") for w in library.get_vocab()]
    odd = ["a", "b", "e", "th", "ing", "é", "漢", "😀", "'s", "'", "!", "1", " ", "\n", "　", "İ", "́", "<|endoftext|>",
           "<|", "ß", "\0", "aaaa", "ha", "<|startoftext|>", "Σς", "ﬁ", "\r\n", "٣"]
    for n in range(6000):
        text = "".join(rng.choice(odd if n % 2 else words) for _ in range(rng.randint(0, 12 if n % 2 else 4)))
        got = ours.encode(text)
        assert got == ids(library, text), text
        assert ours.decode(got) == library.decode(list(memoryview(got).cast("I")), skip_special_tokens=False), text


@pytest.mark.parametrize("text", ["a" * 40_000, "ab" * 20_000, "th" * 9_999 + "e", "!" * 30_001, "é" * 20_000, "wort " * 20_000])
def test_long_pieces_are_linear_and_exact(pair, text):
    ours, library = pair
    assert ours.encode(text) == ids(library, text)


def test_every_prefix_has_the_last_token_of_its_own_encoding():
    letters = {w: i for i, w in enumerate(["a", "b", "aa", "ab", "aab", "ba", "aaaa", "bab"])}
    merges = bpe.Merges(letters, [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("b", "ab")])
    held = bpe.Bpe.__new__(bpe.Bpe)
    held.merges, held.end, held.strings = merges, "", {i: w for w, i in letters.items()}
    good = merges.reached()
    held.automaton = bpe.SuffixAutomaton({w: i for w, i in letters.items() if i in good})
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice("aab") for _ in range(rng.randint(1, 14)))
        last = held.prefix_tokens(text)
        for at in range(1, len(text) + 1):
            assert last[at] == plain_merges(merges, [letters[x] for x in text[:at]])[-1]
        assert held.piece(text) == plain_merges(merges, [letters[x] for x in text])


def test_automaton_lists_all_words_that_end_somewhere():
    words = {"a": 1, "ab": 2, "b": 3, "cab": 4, "xcab": 5, "ca": 6}
    auto, state = bpe.SuffixAutomaton(words), 0
    for place, letter in enumerate("xcabxab", 1):
        state = auto.step(state << 21 | ord(letter))
        before = "xcabxab"[:place]
        assert [w for w, _ in auto.ends[state]] == [words[w] for w in sorted(words, key=len, reverse=True) if before.endswith(w)]


def test_documents_with_odd_rows(spark, pair):
    _, library = pair
    frame = rows.documents(spark, rows.ODD)
    want = []
    for doc_id, text in rows.ODD:
        e = library.encode(text or "", add_special_tokens=False).ids
        shown = library.decode(e, skip_special_tokens=False)
        want.append((doc_id, len(e), hashlib.sha256(array("I", e).tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[2])
    assert sorted(map(tuple, bpe.round_trip_digests(frame).collect()), key=key) == sorted(want, key=key)
    kept = bpe.encoded(frame)
    texts = {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in bpe.decoded(kept).collect()}
    assert texts == {(w[0], w[3]) for w in want}
    assert {(r["doc_id"], r["n_tokens"], hashlib.sha256(r["ids"]).hexdigest()) for r in kept.collect()} == {w[:3] for w in want}
    assert bpe.round_trip_digests(frame.limit(0)).collect() == []


def test_whole_table_like_the_library(spark, folder, pair):
    from wardlight.llm.queries import QUERIES
    _, library = pair
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_prefix_bpe"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        e = library.encode(d["text"] or "", add_special_tokens=False).ids
        assert got[d["doc_id"]][:2] == (len(e), hashlib.sha256(array("I", e).tobytes()).hexdigest())
