"""Token ids in wavelet-matrix files: one succinct, compressed file per shard.

Documents are dealt to shards by ranges of doc_id.  A shard's ids, each document ended
by the end id, are written as one bit-plane per bit of the largest id, the highest
first; below each plane the ids are parted stably by its bit.  A plane is kept in
blocks of 2^16 bits, each compressed by itself, with the ones before every block.  So
the file answers, by reading a block or two per plane: the token at a place (``access``),
how often a token occurs before a place (``rank``) and where its k-th occurrence is
(``select``), besides whole documents.

Layout, little-endian: magic ``WMX1``; uint32 planes, tokens, documents, blocks per
plane; documents' starts (uint64, one more than documents); planes' zeros (uint64); per
plane and block the ones before it (uint32) and the bytes before it (uint64, one more
than blocks in all); blocks.

Files go to the shared folder through pyarrow's file systems, under a name that no
other attempt uses, and the table of written files names those of the successful
attempts only; it is checkpointed, so a lost executor never rewrites it.

Defined results: null and empty texts are the end id alone; rows with equal doc_ids
follow each other by their text's hash; null doc_ids come first; an empty table gives
no rows and no files; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from wardlight.llm.tables import file_path, query, table, texts
from wardlight.llm.tokens import FILE, encoder
from wardlight.session import checkpointed, shared_folder

MAGIC = b"WMX1"
BLOCK = 1 << 16                                         # bits
END_ID = 2
SHARD_TOKENS = 4_000_000
_FILES = "part long, number long, path string, first long, documents long, tokens long, bytes long"
_WRITTEN = pa.schema([(n, pa.string() if n == "path" else pa.int64()) for n in
                      ("part", "number", "path", "first", "documents", "tokens", "bytes")])
_BY_DOC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64())])


def build(ids: np.ndarray, starts: np.ndarray) -> bytes:
    """The file of a shard; starts: of its documents, and the end."""
    import zstandard
    pack = zstandard.ZstdCompressor(level=1).compress
    ids = ids.astype(np.uint32)
    levels = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    if levels <= 16:
        ids = ids.astype(np.uint16)
    blocks = -(-len(ids) // BLOCK)
    zeros, ones, sizes, body = [], [], [], []
    for level in range(levels - 1, -1, -1):
        bits = ((ids >> level) & 1).astype(bool)
        packed = np.packbits(bits, bitorder="little")
        per_block = [int(bits[b * BLOCK:(b + 1) * BLOCK].sum()) for b in range(blocks)]
        ones.append(np.concatenate([[0], np.cumsum(per_block)[:-1]]) if blocks else [])
        for b in range(blocks):
            body.append(pack(packed[b * BLOCK // 8:(b + 1) * BLOCK // 8].tobytes()))
            sizes.append(len(body[-1]))
        zeros.append(len(ids) - sum(per_block))
        ids = np.concatenate([ids[~bits], ids[bits]])
    head = np.array([levels, len(ids), len(starts) - 1, blocks], "<u4").tobytes()
    places = np.concatenate([[0], np.cumsum(sizes, dtype=np.uint64)]) if sizes else np.zeros(1)
    return b"".join([MAGIC, head, np.asarray(starts, "<u8").tobytes(), np.array(zeros, "<u8").tobytes(),
                     np.concatenate(ones).astype("<u4").tobytes() if blocks else b"", places.astype("<u8").tobytes(),
                     *body])


class Wavelet:
    """Reads a file through ``read(at, size)``; keeps the last block of each plane."""

    def __init__(self, read):
        import zstandard
        self._read, self._unpack = read, zstandard.ZstdDecompressor().decompress
        assert read(0, 4) == MAGIC, "not a wavelet file"
        self.levels, self.tokens, self.documents, self.blocks = map(int, np.frombuffer(read(4, 16), "<u4"))
        at = 20

        def take(kind, n):
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return np.frombuffer(read(at - size, size), kind)
        self.starts = take("<u8", self.documents + 1).astype(np.int64)
        self.zeros = take("<u8", self.levels).astype(np.int64)
        self.ones = take("<u4", self.levels * self.blocks).astype(np.int64).reshape(self.levels, self.blocks)
        self._places = take("<u8", self.levels * self.blocks + 1).astype(np.int64)
        self._body, self._kept = at, {}

    def _block(self, plane, block):
        if self._kept.get(plane, (None,))[0] != block:
            a, b = self._places[plane * self.blocks + block:][:2]
            bits = np.frombuffer(self._unpack(self._read(self._body + int(a), int(b - a))), np.uint8)
            self._kept[plane] = block, np.unpackbits(bits, bitorder="little")
        return self._kept[plane][1]

    def _ones(self, plane, at):
        """Ones before a place of a plane."""
        if at >= self.tokens:
            return self.tokens - int(self.zeros[plane])
        block, rest = divmod(at, BLOCK)
        return int(self.ones[plane, block]) + int(self._block(plane, block)[:rest].sum(dtype=np.int64))

    def access(self, at):
        value = 0
        for plane in range(self.levels):
            bit, ones = int(self._block(plane, at // BLOCK)[at % BLOCK]), self._ones(plane, at)
            value = 2 * value + bit
            at = int(self.zeros[plane]) + ones if bit else at - ones
        return value

    def _range(self, token, at):
        """The token's first place below the last plane, and that of those before ``at``."""
        low = 0
        if token >> self.levels:
            return 0, 0
        for plane in range(self.levels):
            a, b = self._ones(plane, low), self._ones(plane, at)
            if token >> (self.levels - 1 - plane) & 1:
                low, at = int(self.zeros[plane]) + a, int(self.zeros[plane]) + b
            else:
                low, at = low - a, at - b
        return low, at

    def rank(self, token, at):
        """Occurrences of the token before a place."""
        low, high = self._range(token, min(at, self.tokens))
        return high - low

    def select(self, token, k):
        """Place of the token's k-th occurrence, from 0; None beyond the last."""
        low, high = self._range(token, self.tokens)
        if not 0 <= k < high - low:
            return None
        at = low + k
        for plane in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - plane) & 1
            at = self._find(plane, bit, at - int(self.zeros[plane]) if bit else at)
        return at

    def _find(self, plane, bit, k):
        """Place of the k-th such bit, from 0, in a plane."""
        before = self.ones[plane] if bit else np.arange(self.blocks) * BLOCK - self.ones[plane]
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = self._block(plane, block)[:min(BLOCK, self.tokens - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def all_ids(self):
        """Every token in order: from the lowest plane up, each undoes its parting."""
        ids = np.zeros(self.tokens, "<u4")
        for plane in range(self.levels - 1, -1, -1):
            bits = np.concatenate([np.zeros(0, np.uint8)] + [self._block(plane, b) for b in range(self.blocks)])
            bits = bits[:self.tokens].astype(bool)
            up, zeros = np.empty_like(ids), int(self.zeros[plane])
            up[~bits], up[bits] = ids[:zeros], ids[zeros:] | np.uint32(1 << (self.levels - 1 - plane))
            ids = up
        return ids


def open_file(path: str) -> Wavelet:
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    file = system.open_input_file(name)
    return Wavelet(lambda at, size: file.read_at(size, at))


def _written(path, end_id, folder, shard_tokens):
    def write(batches):
        from pyarrow import fs
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base)
        encode, end, part = encoder(path).encode, int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        number, ids, docs, size = 0, [], [], 0

        def flush():
            nonlocal number, ids, docs, size
            starts = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            content = build(np.frombuffer(b"".join(ids), "<u4"), starts)
            name = f"{part:07d}-{number:05d}-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{base}/{name}.wm") as out:
                out.write(content)
            table = pa.table({"doc_id": pa.array(docs, pa.int64())})
            with system.open_output_stream(f"{base}/{name}.ids") as out, pa.ipc.new_file(out, table.schema) as ipc:
                ipc.write_table(table)
            row = {"part": part, "number": number, "path": f"{folder}/{name}", "first": docs[0],
                   "documents": len(docs), "tokens": size, "bytes": len(content)}
            number, ids, docs, size = number + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=_WRITTEN)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(encode(text.as_py()) + end)
                docs.append(doc_id)
                size += len(ids[-1]) // 4
                if size >= shard_tokens:
                    yield flush()
        if docs:
            yield flush()
    return write


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; one row per file, in
    the order of (part, number).  A document is never split over files."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark) + "/wavelet"
    if "://" not in folder:
        folder = f"file://{folder}"
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    files = rows.mapInArrow(_written(tokenizer or file_path(FILE), end_id, folder, shard_tokens), _FILES)
    return checkpointed(spark, files)


def _read(batches):
    from pyarrow import fs
    for batch in batches:
        for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = open_file(f"{path}.wm")
            system, name = fs.FileSystem.from_uri(f"{path}.ids")
            docs = pa.ipc.open_file(system.open_input_file(name)).read_all()["doc_id"].combine_chunks()
            ids, starts = memoryview(shard.all_ids()).cast("B"), shard.starts
            crcs = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([docs, pa.array(starts[:-1] + before), pa.array(np.diff(starts)),
                                              pa.array(crcs, pa.int64())], schema=_BY_DOC)


def read_documents(files: DataFrame) -> DataFrame:
    """Each document's place and crc32, from the files."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens"))
                         .alias("part_before"))
    in_part = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    placed = files.withColumn("in_part", in_part).join(parts, "part")
    placed = placed.select("path", (F.col("part_before") + F.col("in_part")).alias("before"))
    spread = placed.repartition(max(1, min(placed.count(), 4096)), F.xxhash64("path"))
    return spread.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op4_wavelet_matrix")
def op4(spark, folder):
    return read_documents(write_shards(table(spark, folder, "documents")))
