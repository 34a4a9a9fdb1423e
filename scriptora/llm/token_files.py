"""Token-id files with fixed-width bit packing: vectorised unpacking and random access by document."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.llm import files
from scriptora.llm.common import text_bytes
from scriptora.llm.tokens import encoder
from scriptora.sources.shared import work_path

#: A file: MAGIC, blocks, block offsets (u64), documents (id i64, null flag u8, first id u64 as three arrays), TRAILER.
#: TRAILER: bits, ids a block, blocks, documents, ids, place of the block offsets, MAGIC. All little-endian.
MAGIC = b"BITTOK01"
TRAILER = struct.Struct("<IIQQQQ8s")
BLOCK = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(np.ascontiguousarray(ids, "<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, "u1"), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), "u1")
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


class Writer:
    """Packs ids into blocks as they come; holds one block and 17 bytes a document."""

    def __init__(self, out: pa.NativeFile, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.offsets, self.docs, self.nulls, self.starts, self.held, self.ids, self.waiting = [], [], [], [], [], 0, 0
        out.write(MAGIC)
        self.at = len(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc or 0)
        self.nulls.append(doc is None)
        self.starts.append(self.ids)
        self.ids += len(ids)
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            every = np.concatenate(self.held)
            full = len(every) // self.block * self.block
            for k in range(0, full, self.block):
                self._write(every[k : k + self.block])
            self.held, self.waiting = [every[full:]], len(every) - full

    def _write(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._write(np.concatenate(self.held))
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), (self.nulls, "u1"), (self.starts, "<u8")):
            self.out.write(np.array(values, kind).tobytes())
        self.out.write(TRAILER.pack(self.bits, self.block, len(self.offsets), len(self.docs), self.ids, self.at, MAGIC))
        return len(self.docs), self.ids


class Reader:
    """Random access to a file's documents and ids."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        source.seek(size - TRAILER.size)
        self.bits, self.block, blocks, docs, self.ids, at, magic = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file, or a torn one")
        source.seek(at)
        tail = source.read(size - TRAILER.size - at)
        self.offsets = np.frombuffer(tail, "<u8", blocks)
        self.docs = np.frombuffer(tail, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(tail, "u1", docs, 8 * (blocks + docs))
        self.starts = np.append(np.frombuffer(tail, "<u8", docs, 8 * (blocks + docs) + docs), np.uint64(self.ids)).astype("i8")

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids start to end of the file; only the blocks that hold them are read."""
        out = []
        for k in range(start // self.block, -(-end // self.block) if end > start else start // self.block):
            n = min(self.block, self.ids - k * self.block)
            self.source.seek(int(self.offsets[k]))
            out.append(unpack_bits(self.source.read(-(-n * self.bits // 8)), self.bits, n))
        first = start // self.block * self.block
        return np.concatenate(out)[start - first : end - first] if out else np.zeros(0, "<u4")

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.starts[k]), int(self.starts[k + 1]))


def write_tokens(df: DataFrame, folder: str, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of every whole text of df (doc_id, text), each ending in end_id, in ascending order of doc_id; returns the manifest.

    Files hold ranges of doc_id, so the ids of file after file are in order; a
    null doc_id comes first. Null and empty texts have end_id alone; repeated
    rows are documents of their own. No rows give no files.
    """

    def write(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> tuple[int, int]:
        words = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        writer = Writer(out, bits_for(max(words.tokenizer.get_vocab_size(), end_id + 1)))
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                writer.add(doc, np.frombuffer(words.encode(text) + end, "<u4"))
        return writer.close()

    dealt = df.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id")
    return files.write_files(dealt.sortWithinPartitions("doc_id", F.xxhash64("text")), folder, "tok", write)


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and on request ids of each document, from the files."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def read(source: pa.NativeFile, row: dict) -> Iterator[pa.RecordBatch]:
        reader = Reader(source)
        n, k = len(reader.docs), 0
        while k < n:
            end = max(k + 1, int(np.searchsorted(reader.starts, reader.starts[k] + (1 << 20), "right")) - 1)
            end = min(end, n)
            data, base = reader.read(int(reader.starts[k]), int(reader.starts[end])).tobytes(), int(reader.starts[k])
            own = [data[4 * (int(reader.starts[x]) - base) : 4 * (int(reader.starts[x + 1]) - base)] for x in range(k, end)]
            columns = [pa.array(reader.docs[k:end], mask=reader.nulls[k:end].astype(bool)), pa.array(reader.starts[k:end] + row["before"]), pa.array(np.diff(reader.starts[k : end + 1])), pa.array([zlib.crc32(x) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * with_ids, names)
            k = end

    return files.read_files(files.before(manifest), read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def token_round_trip(df: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes df's ids to a new folder of the shared one and gives what its files hold."""
    return read_tokens(write_tokens(df, work_path(df.sparkSession, "tokens"), tokenizer, end_id))
