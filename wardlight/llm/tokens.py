"""Token ids of whole texts by the tokenizers library, with words encoded once per worker.

A tokenizer of the word-BPE kind never merges across white space, so a text's ids are
the ids of its blank-separated chunks in order.  Texts of plain letters, digits and
ASCII signs are cut as the tokenizer's own pattern cuts them, and the pieces given to
its model; chunks of any other text go through the whole tokenizer.  ``tests/llm``
compares both.
"""

from __future__ import annotations

import re
from array import array

#: The vocabulary whose normaliser and split pattern the short way below repeats.
FILE = "word_bpe_49k.json"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PIECES = re.compile(rf"[{_LETTERS}]+|[0-9]|[!-/:-@\[-`{{-~]+")
#: No apostrophe: it opens contractions.
_PLAIN = re.compile(rf"[ \t\r\n{_LETTERS}0-9!-&(-/:-@\[-`{{-~]*\Z")


def _byte_letters() -> dict[int, str]:
    """Code point to the letters that byte-level BPE writes for its UTF-8 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class _Kept(dict):
    """Ids (little-endian unsigned 32-bit) by text; begins anew beyond ``most`` entries."""

    def __init__(self, ids, most):
        super().__init__()
        self.ids, self.most = ids, most

    def __missing__(self, text):
        found = array("I", self.ids(text)).tobytes()
        if len(text) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[text] = found
        return found


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    ``most`` bounds the cache of pieces, in entries.  The short way holds for
    :data:`FILE`; with another file every chunk goes through the library, which is
    right for each tokenizer that drops white space.
    """

    def __init__(self, path: str, most: int = 600_000):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        model, letters = tokenizer.model, _byte_letters()
        self.plain = path.endswith(FILE)
        self.pieces = _Kept(lambda w: [t.id for t in model.tokenize(w if w.isascii() else w.translate(letters))], most)
        self.chunks = _Kept(lambda c: tokenizer.encode(c, add_special_tokens=False).ids, most // 10)

    def encode(self, text: str) -> bytes:
        if self.plain and "<|" not in text and _PLAIN.match(text):
            return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower())))
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; tasks that share a worker share its caches."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
