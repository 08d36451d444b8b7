"""BPE encoding by one pass over every prefix, and decoding.

The last token of a prefix's encoding is unique: it is the one token ending there that
can stand beside the last token of what is left of it.  A piece of text is therefore
encoded from left to right.  A suffix automaton of the vocabulary (a state per vocabulary
prefix, each linked to its longest suffix) lists the tokens that end at a place, longest
first; a pair test tells whether two tokens may stand side by side; the token that
passes is stored for the prefix.  Back-pointers from the end of the piece give the ids.
The work is linear in the piece, whatever its length, as tokens have a greatest length.

Two tokens may stand side by side if merging never joins them: each merge has a rank, so
walking back through the tokens' inner edges, latest merge first, shows every pair of
parts that ever met at the border; one that merges before either part is used up (or,
between equal ranks, further left) forbids the pair.

Normalising and cutting into pieces are the tokenizer file's own; strings of its special
tokens are cut out first, as the tokenizers library does.  Its model is never run.
Decoding joins the tokens' strings with blanks, as the library does for a file without
decoder.

Defined results: a null text is empty; an empty text has no ids; documents of one doc_id
are documents of their own; a null doc_id stays null; an empty table gives no rows;
other columns are not read.  A document is held by one task as one row, like its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame

from wardlight.llm.tables import file_path, query, table, texts
from wardlight.llm.tokens import _PIECES, _PLAIN, FILE, _byte_letters, _Kept

#: Stands for the mark of a piece's end inside the automaton; no token holds it.
END = "\0"
_NEVER = 1 << 60


class Merges:
    """The vocabulary with its merges: which tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.born = array("q", [-1]) * size                   # rank of the merge that makes a token
        self.left, self.right = array("q", [-1]) * size, array("q", [-1]) * size
        self.rank, self.known, self.size = {}, {}, size
        for rank, (a, b) in enumerate(merges):
            x, y, made = vocabulary[a], vocabulary[b], vocabulary[a + b]
            if self.rank.setdefault(x * size + y, rank) == rank and self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, x, y

    def _apart(self, x: int, y: int, ends: int) -> bool:
        """No parts of x and y merge over the border before rank ``ends``."""
        x_ends = y_ends = ends
        while True:
            rank = self.rank.get(x * self.size + y, _NEVER)
            if rank < x_ends and rank <= y_ends and rank < ends:
                return False
            x_born, y_born = self.born[x], self.born[y]
            if x_born < 0 and y_born < 0:
                return True
            if x_born > y_born:
                x, x_ends = self.right[x], x_born
            else:
                y, y_ends = self.left[y], y_born

    def side_by_side(self, x: int, y: int) -> bool:
        key = x * self.size + y
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            found = self.known[key] = self._apart(x, y, _NEVER)
        return found

    def reached(self) -> set[int]:
        """Tokens that encoding their own string gives back."""
        good = {i for i in range(self.size) if self.born[i] < 0}
        for made in sorted((i for i in range(self.size) if self.born[i] >= 0), key=self.born.__getitem__):
            x, y, rank = self.left[made], self.right[made], self.born[made]
            if x in good and y in good and max(self.born[x], self.born[y]) < rank and self._apart(x, y, rank):
                good.add(made)
        return good


class SuffixAutomaton:
    """Which of the given words end at a place of a text: ``ends[state]`` holds their
    (token, length), longest first."""

    def __init__(self, words: dict[str, int]):
        following, token, letters, parents, depth = {}, {}, [0], [0], [0]
        for word, number in words.items():
            at = 0
            for letter in map(ord, word):
                key = at << 21 | letter
                at = following.get(key, 0)
                if not at:
                    at = following[key] = len(depth)
                    depth.append(depth[key >> 21] + 1)
                    letters.append(letter)
                    parents.append(key >> 21)
            token[at] = number
        #: Grows by the steps that fall back to a suffix, so each is walked once.
        self.next, self.suffix, self.ends = following, [0] * len(depth), [()] * len(depth)
        for state in sorted(range(1, len(depth)), key=depth.__getitem__):
            if parents[state]:
                self.suffix[state] = self.step(self.suffix[parents[state]] << 21 | letters[state])
            shorter = self.ends[self.suffix[state]]
            self.ends[state] = ((token[state], depth[state]), *shorter) if state in token else shorter

    def step(self, key: int) -> int:
        """The state after ``key``, a state and a letter: the longest suffix that the vocabulary goes on from."""
        to = self.next.get(key)
        if to is None:
            at = key >> 21
            to = self.step(self.suffix[at] << 21 | key & 0x1FFFFF) if at else 0
            if len(self.next) < 2_000_000:
                self.next[key] = to
        return to


class Bpe:
    """Encoder and decoder of a tokenizers file of the word-BPE kind; ``most`` bounds the
    cache of short pieces, in entries."""

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.cutter = tokenizer.normalizer, tokenizer.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        vocabulary, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # a merge's left part never carries the end mark, so parts join as plain strings
        self.merges = Merges(vocabulary, merges)
        reached, mark = self.merges.reached(), len(self.end)
        self.automaton = SuffixAutomaton({(w[:-mark] + END if mark and w.endswith(self.end) and w != self.end else w): i
                                          for w, i in vocabulary.items() if i in reached})
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.strings = {i: w for w, i in (vocabulary | self.special).items()}
        self.plain = path.endswith(FILE)                       # its pattern has the short way of tokens.py
        letters = _byte_letters()
        self.pieces = _Kept(lambda w: self.piece(w if w.isascii() else w.translate(letters)), most)
        self.chunks = _Kept(self._chunk, most // 10)

    def prefix_tokens(self, piece: str) -> list[int]:
        """The last token of each prefix's encoding, by the prefix's length; the whole piece last."""
        following, step, ends = self.automaton.next.get, self.automaton.step, self.automaton.ends
        known, beside, size = self.merges.known.get, self.merges.side_by_side, self.merges.size
        n, state, last = len(piece), 0, [-1] * (len(piece) + 1)
        symbols = [(at + 1, ord(letter)) for at, letter in enumerate(piece)]
        if self.end and piece:                                 # the last letter and the mark are one symbol
            state_at = n - 1
            symbols.append((n + 1, 0))
        else:
            state_at = -1
        for end, letter in symbols:
            key = state << 21 | letter
            state = following(key)
            if state is None:
                state = step(key)
            if end - 1 == state_at:
                continue
            for token, length in ends[state]:
                start = end - length
                if start <= 0:
                    fits = start == 0
                elif start >= n or last[start] < 0:
                    fits = False
                else:
                    fits = known(last[start] * size + token)
                    if fits is None:
                        fits = beside(last[start], token)
                if fits:
                    last[end if end < n else n] = token
                    break
        return last

    def piece(self, piece: str) -> list[int]:
        """Ids of one piece, by back-pointers from its end."""
        last, at, ids, mark = self.prefix_tokens(piece), len(piece), [], len(self.end)
        while at:
            token = last[at]
            if token < 0:
                raise ValueError(f"the vocabulary has no symbol for a letter of {piece[:at][-20:]!r}")
            at -= len(self.strings[token]) - (mark if not ids else 0)
            ids.append(token)
        return ids[::-1]

    def _chunk(self, chunk: str) -> list[int]:
        """Ids of text without special tokens, cut by the file's own rules."""
        cut = self.cutter.pre_tokenize_str(self.normalizer.normalize_str(chunk)) if chunk else []
        return [i for piece, _ in cut for i in self.piece(piece)]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.plain and "<|" not in text and _PLAIN.match(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        parts = self.cut.split(text) if self.cut else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif self.plain:                                   # white space is dropped, so no piece crosses it
                out.extend(map(self.chunks.__getitem__, part.replace("\n", " ").split(" ")))
            else:
                out.append(self.chunks[part])
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Special tokens included; ids that the file doesn't have are left out, as by the library."""
        strings = self.strings
        return " ".join([strings[i] for i in memoryview(ids).cast("I") if i in strings])


_BPES: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    """The worker's encoder of a file."""
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def _encoded(path):
    def encode(batches):
        coder = bpe(path)
        for batch in batches:
            ids = [coder.encode(text.as_py()) for text in batch.column(1)]
            values = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(ids, pa.binary())],
                                             names=["doc_id", "n_tokens", "ids"])
    return encode


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the ids of the whole text, little-endian unsigned 32-bit, as binary."""
    return texts(docs).mapInArrow(_encoded(tokenizer or file_path(FILE)), "doc_id long, n_tokens long, ids binary")


def _decoded(path):
    def decode(batches):
        coder = bpe(path)
        for batch in batches:
            texts_ = [coder.decode(x.as_py() or b"") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts_, pa.string())], names=["doc_id", "text"])
    return decode


def decoded(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text of rows with ``ids`` as :func:`encoded` gives them; null ids are none."""
    return rows.select("doc_id", "ids").mapInArrow(_decoded(tokenizer or file_path(FILE)), "doc_id long, text string")


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digested(path):
    def digest(batches):
        coder = bpe(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column(1):
                ids = coder.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()),
                                              pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return digest


def round_trip_digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of each document's ids and of the text they decode to, without passing both on."""
    return texts(docs).mapInArrow(_digested(tokenizer or file_path(FILE)), _DIGESTS)


@query("op13_prefix_bpe")
def op13(spark, folder):
    return round_trip_digests(table(spark, folder, "documents"))
