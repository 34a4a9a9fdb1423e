"""WARC archives as seekable Zstandard bundles: frames of records, a record index and a footer seek table."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.llm import files
from scriptora.llm.common import compact, materialise, text_bytes
from scriptora.sources.shared import work_path

#: Numbers of the public seekable format: skippable frames, and the end of the seek table. The record index has a skippable frame of its own.
SKIP_TABLE, SKIP_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
FRAME = 1 << 18
LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Upper halves of record ids; the lower half is the page's number.
OWN, NAMELESS = uuid.uuid5(uuid.NAMESPACE_URL, "scriptora:page").int >> 64, uuid.uuid5(uuid.NAMESPACE_URL, "scriptora:nameless").int >> 64


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(int=(NAMELESS if page is None else OWN) << 64 | ((page or 0) & 0xFFFFFFFFFFFFFFFF))}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").rpartition(":")[2]).int
    low = value & 0xFFFFFFFFFFFFFFFF
    return None if value >> 64 == NAMELESS else low - (1 << 64) if low >> 63 else low


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple | None, date: str) -> bytes:
    """A response record with the payload, or a revisit record that names the page in refers_to; both say the full payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (b"" if refers_to else payload)
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url else []), "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0])}"] if refers_to else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, start: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at start."""
    head = data.index(b"\r\n\r\n", start)
    first, *lines = data[start:head].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no record starts here")
    headers = dict(line.split(": ", 1) for line in lines)
    end = head + 4 + int(headers["Content-Length"])
    return headers, data[head + 4 : end], end + 4


class Writer:
    """Groups records into independent frames of about FRAME bytes; holds one frame and the index."""

    def __init__(self, out: pa.NativeFile, frame: int = FRAME, level: int = 3):
        self.out, self.frame, self.press = out, frame, zstandard.ZstdCompressor(level=level)
        self.sizes, self.index, self.held, self.size = [], [], [], 0

    def add(self, page: int | None, data: bytes) -> None:
        self.index.append((page or 0, page is None, len(self.sizes), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        if self.size >= self.frame:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            pressed = self.press.compress(b"".join(self.held))
            self.out.write(pressed)
            self.sizes.append((len(pressed), self.size))
            self.held, self.size = [], 0

    def close(self) -> tuple[int, int]:
        self._flush()
        index = self.press.compress(np.array(self.index, "<i8").tobytes())
        self.out.write(struct.pack("<II", SKIP_INDEX, len(index)) + index)
        self.sizes.append((len(index) + 8, 0))
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIP_TABLE, len(table)) + table)
        return len(self.index), sum(x for x, _ in self.sizes)


class Reader:
    """Frames and records of an archive, each reachable without the others."""

    def __init__(self, source: pa.NativeFile):
        self.source, size = source, source.size()
        source.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table: not a seekable archive, or a torn one")
        source.seek(size - 9 - 8 * n)
        table = np.frombuffer(source.read(8 * n), "<u4").reshape(n, 2).astype("i8")
        self.places = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.sizes = table[:, 1]
        index = self._bytes(n - 1)[8:]
        #: page, whether it has none, frame, offset in the frame's text, length
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(index), "<i8").reshape(-1, 5) if index else np.zeros((0, 5), "i8")
        self.frames = n - 1

    def _bytes(self, k: int) -> bytes:
        self.source.seek(int(self.places[k]))
        return self.source.read(int(self.places[k + 1] - self.places[k]))

    def frame(self, k: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._bytes(k), max_output_size=int(self.sizes[k]))

    def record(self, page: int) -> tuple[dict[str, str], bytes]:
        k = int(np.flatnonzero((self.index[:, 0] == page) & (self.index[:, 1] == 0))[0])
        _, _, frame, at, _ = self.index[k]
        return parse_record(self.frame(int(frame)), int(at))[:2]


#: Revisits that are sent to all tasks at once; beyond that they are joined with the pages by shuffling.
SENT = 1_000_000


def revisits(df: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, digest, target) of each different (page_id, payload) of df (page_id, html) that repeats one of `least` bytes or more, a written table.

    Only ids and digests are shuffled; the count of a payload that very many
    pages have is combined before it is.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = materialise(df.select(F.col("page_id").cast("long"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n")).distinct(), "digests")
    last = own.where(F.col("n") >= least).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("pages")).where("pages > 1 and target is not null").select("digest", "target")
    return materialise(own.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("target"))).select("page_id", "digest", "target"), "revisits")


def write_archives(df: DataFrame, folder: str, least: int = LEAST, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of df (page_id, url, html; null html is empty) and returns the manifest.

    Of pages with equal payloads of at least `least` bytes the one with the
    largest page_id is a response and the others are revisits of it; repeated
    rows of that page are responses too, and pages without a page_id revisit
    one that has it. No rows give no files. Pages are not shuffled while the
    revisits are few enough to be sent to them.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    of = revisits(df, least).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "target")
    of = F.broadcast(of) if of.count() <= SENT else of
    full = df.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"))
    told = full.join(of, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "html", "digest", "target")

    def write(batches: Iterator[pa.RecordBatch], out: pa.NativeFile) -> tuple[int, int]:
        writer = Writer(out)
        for b in batches:
            for page, url, html, digest, target in zip(*(b.column(c).to_pylist() for c in ("page_id", "url")), text_bytes(b.column("html")), *(b.column(c).to_pylist() for c in ("digest", "target")), strict=True):
                writer.add(page, record(page, url, html, digest, None if target is None else (target,), date))
        return writer.close()

    return files.write_files(compact(told), folder, "warc.zst", write)


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and on request url and payload of each record, from the archives."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["url", "payload"] * with_payload

    def read(source: pa.NativeFile, row: dict) -> Iterator[pa.RecordBatch]:
        reader = Reader(source)
        for k in range(reader.frames):
            data, at, out = reader.frame(k), 0, []
            while at < len(data):
                headers, block, at = parse_record(data, at)
                http, _, payload = block.partition(b"\r\n\r\n")
                digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = headers["WARC-Type"] == "response"
                if response and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{row['path']}: a payload does not have its digest")
                length = int(http.decode().rpartition("Content-Length: ")[2])
                if response and length != len(payload):
                    raise ValueError(f"{row['path']}: a payload does not have its length")
                target = headers.get("WARC-Refers-To")
                out.append((page_of(headers["WARC-Record-ID"]), len(payload) if response else length, digest, headers["WARC-Type"], target and page_of(target), headers.get("WARC-Target-URI"), payload if response else None)[: len(names)])
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=False)], names)

    return files.read_files(manifest, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload)


def archive_round_trip(df: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes df to a new folder of the shared one and gives what its archives hold."""
    return read_archives(write_archives(df, work_path(df.sparkSession, "warc"), least))
