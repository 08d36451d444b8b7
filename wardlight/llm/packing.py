"""Hierarchical packing of token sequences for several context sizes.

Each document's ids are routed by length: whole windows of the longest tier are cut
off first, and what remains waits in the smallest tier that holds it.  A tier's window
is opened by one waiting piece, and its gap is filled from shorter tiers, the best fit
first; a last gap that no waiting piece fits is filled by cutting one.  Closed windows
of a tier are dealt to step groups of equal token counts, and the groups of one deal
get like attention costs (the sum of squared piece lengths).

A task packs the rows it reads, so nothing is shuffled.  A tier waits for ``waiting``
pieces and the ids of a window, so a task holds a bounded number of ids and one deal of
closed windows.  At its end
the waiting ids fill windows of the longest tier, and the rest is cut into powers of
two, so no window has padding.  Sequence and group numbers hold the partition's number,
so a task that runs again on the same rows gives the same result.

Defined results: null and empty texts are the end id alone; repeated doc_ids are packed
row by row; an empty table gives no rows; columns other than doc_id and text are not
read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from wardlight.llm.tables import file_path, query, table, texts
from wardlight.llm.tokens import FILE, encoder

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
END_ID = 1
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier int, step_group long")
_FIELDS = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in
                     ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier",
                      "step_group")])
#: Sequences and groups of a partition are numbered from its number times this.
PART = 1 << 36


class Packer:
    """Packs documents one by one; ``rows`` collects a tuple of :data:`SCHEMA` per piece."""

    def __init__(self, partition=0, tiers=TIERS, step_tokens=STEP_TOKENS, waiting=64, deals=4):
        self.tiers, self.step_tokens, self.waiting, self.deals = sorted(tiers), step_tokens, waiting, deals
        self.sequence = self.group = partition * PART
        self.pool = {t: [] for t in self.tiers}         # (length, number, doc_id, start, ids, doc_tokens), by length
        self.held = dict.fromkeys(self.tiers, 0)        # ids in a pool
        self.closed = {t: [] for t in self.tiers}
        self.number, self.rows = 0, []

    def add(self, doc_id, ids: bytes):
        """ids: little-endian unsigned 32-bit."""
        tokens, top, at = len(ids) // 4, self.tiers[-1], 0
        while tokens - at >= top:
            self._close(top, [(doc_id, at, ids[4 * at:4 * (at + top)], tokens)])
            at += top
        if at < tokens:
            self._route((doc_id, at, ids[4 * at:], tokens))

    def _route(self, piece):
        length = len(piece[2]) // 4
        tier = next(t for t in self.tiers if t >= length)
        if length == tier:
            self._close(tier, [piece])
            return
        self.number += 1
        insort(self.pool[tier], (length, self.number, piece))
        self.held[tier] += length
        if len(self.pool[tier]) >= self.waiting and sum(self.held[t] for t in self.tiers if t <= tier) >= tier:
            self._fill(tier)

    def _take(self, tier, at):
        length, _, piece = self.pool[tier].pop(at)
        self.held[tier] -= length
        return length, piece

    def _fill(self, tier):
        """Opens a window with the tier's longest piece and closes it full."""
        gap, pieces = tier, []
        length, piece = self._take(tier, -1)
        pieces.append(piece)
        gap -= length
        lower = [t for t in self.tiers if t <= tier][::-1]
        for t in lower:
            while gap and (at := bisect_right(self.pool[t], (gap, self.number + 1))):
                length, piece = self._take(t, at - 1)
                pieces.append(piece)
                gap -= length
        if gap:                                         # every waiting piece is longer than the gap
            shortest = next(t for t in reversed(lower) if self.pool[t])
            doc_id, start, ids, tokens = self._take(shortest, 0)[1]
            pieces.append((doc_id, start, ids[:4 * gap], tokens))
            self._close(tier, pieces)
            self._route((doc_id, start + gap, ids[4 * gap:], tokens))
        else:
            self._close(tier, pieces)

    def _close(self, tier, pieces):
        windows = self.closed.setdefault(tier, [])
        windows.append((sum(len(p[2]) ** 2 for p in pieces), self.sequence, pieces))
        self.sequence += 1
        if len(windows) >= self.deals * max(1, self.step_tokens // tier):
            self._deal(tier)

    def _deal(self, tier):
        """Costly windows first, forth and back over the groups."""
        windows = sorted(self.closed[tier], key=lambda w: (-w[0], w[1]))
        per_group = max(1, self.step_tokens // tier)
        groups = -(-len(windows) // per_group)
        for i, (_, sequence, pieces) in enumerate(windows):
            turn, place = divmod(i, groups)
            group, offset = self.group + (place if turn % 2 == 0 else groups - 1 - place), 0
            for doc_id, start, ids, tokens in pieces:
                self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, tier, group))
                offset += len(ids) // 4
        self.group += groups
        self.closed[tier] = []

    def finish(self):
        left = [entry[2] for t in reversed(self.tiers) for entry in self.pool[t]]
        self.pool, self.held = {t: [] for t in self.tiers}, dict.fromkeys(self.tiers, 0)
        total, top = sum(len(p[2]) // 4 for p in left), self.tiers[-1]
        while total:
            tier = gap = top if total >= top else 1 << (total.bit_length() - 1)
            pieces = []
            while gap:
                doc_id, start, ids, tokens = left.pop()
                used = min(gap, len(ids) // 4)
                pieces.append((doc_id, start, ids[:4 * used], tokens))
                if 4 * used < len(ids):
                    left.append((doc_id, start + used, ids[4 * used:], tokens))
                gap -= used
            total -= tier
            self._close(tier, pieces)
        for tier in list(self.closed):
            if self.closed[tier]:
                self._deal(tier)

    def taken(self):
        rows, self.rows = self.rows, []
        return rows


def _packed(path, end_id, options):
    def pack(batches):
        encode, end = encoder(path).encode, int(end_id).to_bytes(4, "little")
        packer = Packer(TaskContext.get().partitionId(), **options)

        def out():
            rows = packer.taken()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FIELDS)],
                                              schema=_FIELDS)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py()) + end)
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.finish()
        if packer.rows:
            yield out()
    return pack


def packed_sequences(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tiers=TIERS,
                     step_tokens: int = STEP_TOKENS, waiting: int = 64) -> DataFrame:
    """One row per piece of a document: its place in the document, the crc32 of its ids,
    and its place in a sequence; ``tier`` is the sequence's length, ``step_group`` its
    group.  ``tiers`` are powers of two."""
    options = {"tiers": tuple(tiers), "step_tokens": step_tokens, "waiting": waiting}
    return texts(docs).mapInArrow(_packed(tokenizer or file_path(FILE), end_id, options), SCHEMA)


@query("op1_hierarchical_packing")
def op1(spark, folder):
    return packed_sequences(table(spark, folder, "documents"))
