"""SimHash near-duplicates: pigeonhole blocks of the fingerprint, joined, then verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scriptora.llm.common import compact, fresh, materialise, text_bytes
from scriptora.llm.components import connected_components, forest

WORDS, DISTANCE, SEED, BLOCKS = 3, 3, 42, 6
#: Fingerprints that share a key and are compared in one task; keys with more are split further.
TOGETHER = 1024


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64 bits, each set if it is set in over half the hashes of the text's shingles; 0 if there is no word."""
    found = text.lower().split()  # bytes: A-Z alone are lower-cased
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, found), "i8", len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    hashed, digest = [], xxhash.xxh64_intdigest
    for a, b in zip(starts, ends[words - 1 :].tolist(), strict=False):
        hashed.append(digest(joined[a:b], seed))
    total = np.zeros(64, "i8")
    for at in range(0, len(hashed), 65536):
        own = np.array(hashed[at : at + 65536], "<u8")
        total += np.unpackbits(own.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int.from_bytes(np.packbits(2 * total > len(hashed), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each document (doc_id, text); fp holds the 64 bits as a signed number."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(x, words, seed) for x in text_bytes(b.column(1))], "u8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view("i8"))], schema=schema)

    return compact(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(hashed, "doc_id long, fp long")


def _layout(blocks: int) -> list[tuple[int, int]]:
    """Shift and width of each block."""
    at = [64 * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _gather(fps: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(len(fps), "u8")
    for shift, width in blocks:
        out = (out << np.uint64(width)) | ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def _keys(blocks: int, distance: int) -> list[tuple[int, ...]]:
    """Blocks that make up each key: two fingerprints differ in at most `distance` blocks, so all others agree, and one key is of those."""
    return list(combinations(range(blocks), blocks - distance))


def _keyed(batches: Iterator[pa.RecordBatch], blocks: int, distance: int) -> Iterator[pa.RecordBatch]:
    layout = _layout(blocks)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view("u8")
        for k, chosen in enumerate(_keys(blocks, distance)):
            key = (np.uint64(k) << np.uint64(56)) | _gather(fps, [layout[x] for x in chosen])
            yield pa.RecordBatch.from_arrays([pa.array(key.view("i8")), b.column("fp")], ["key", "fp"])


def _finer(batches: Iterator[pa.RecordBatch], blocks: int, distance: int) -> Iterator[pa.RecordBatch]:
    """Of a key with too many fingerprints: what the key leaves out, in distance + 1 parts, of which two near fingerprints share one."""
    layout, keys = _layout(blocks), _keys(blocks, distance)
    for b in batches:
        key, fps = (b.column(c).to_numpy(zero_copy_only=False).view("u8") for c in ("key", "fp"))
        for k, chosen in enumerate(keys):
            if len(own := np.flatnonzero(key >> np.uint64(56) == k)):
                free = [layout[x] for x in range(blocks) if x not in chosen]
                rest, bits = _gather(fps[own], free), sum(w for _, w in free)
                at = [bits * x // (distance + 1) for x in range(distance + 2)]
                for part, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
                    value = (rest >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(key[own].view("i8")), pa.array((value << np.uint64(8) | np.uint64(part)).view("i8")), pa.array(fps[own].view("i8"))], ["key", "sub", "fp"])


def _compare(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges between fingerprints with equal keys (sorted): the links of small runs, of larger ones enough to connect what is linked."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, "i8")
    sizes = np.diff(np.append(starts, len(keys)))
    a, b = [], []
    small = np.repeat(sizes <= 8, sizes)
    for step in range(1, 8):
        if len(keys) <= step or (sizes[sizes <= 8].max(initial=0)) <= step:
            break
        i = np.flatnonzero((keys[:-step] == keys[step:]) & small[:-step])
        i = i[np.bitwise_count(fps[i] ^ fps[i + step]) <= distance]
        a.append(fps[i])
        b.append(fps[i + step])
    for at, n in zip(starts[sizes > 8], sizes[sizes > 8], strict=True):
        own, i, j = np.unique(fps[at : at + n]), [], []
        for lo in range(0, len(own), 512):
            near = np.bitwise_count(own[lo : lo + 512, None] ^ own[None, :]) <= distance
            x, y = np.nonzero(near)
            i.append(x[x + lo < y] + lo)
            j.append(y[x + lo < y])
        member, root = forest(len(own), np.concatenate(i), np.concatenate(j))
        a.append(own[member])
        b.append(own[root])
    return a, b


def _linked(batches: Iterator[pa.RecordBatch], distance: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Edges (kind 0, a, b) from rows (key, fp) that come sorted by key; rows of a key with over `most` fingerprints go on as (kind 1, key, fp)."""

    def out(kind: int, a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y = (np.concatenate(v) if v else np.zeros(0, "u8") for v in (a, b))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, "i4")), pa.array(x.view("i8")), pa.array(y.view("i8"))], ["kind", "a", "b"])

    keys, fps, large = np.zeros(0, "u8"), np.zeros(0, "u8"), None
    for batch in batches:
        keys, fps = (np.concatenate([x, batch.column(c).to_numpy(zero_copy_only=False).view("u8")]) for c, x in (("key", keys), ("fp", fps)))
        if not len(keys):
            continue
        if large is not None:
            n = int(np.searchsorted(keys != large, True)) if (keys != large).any() else len(keys)
            yield from out(1, [keys[:n]], [fps[:n]])
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            large = None
        last = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if keys[0] != keys[-1] else 0
        yield from _runs(keys[:last], fps[:last], distance, most, out)
        keys, fps = keys[last:], fps[last:]
        if most and len(keys) > most:
            large = keys[0]
            yield from out(1, [keys], [fps])
            keys, fps = keys[:0], fps[:0]
    yield from _runs(keys, fps, distance, most, out)


def _runs(keys, fps, distance, most, out):
    if most and len(keys):
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        over = np.repeat(np.diff(np.append(starts, len(keys))) > most, np.diff(np.append(starts, len(keys))))
        yield from out(1, [keys[over]], [fps[over]])
        keys, fps = keys[~over], fps[~over]
    yield from out(0, *_compare(keys, fps, distance))


def _join(keyed: DataFrame, distance: int, most: int | None) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_linked, distance=distance, most=most), "kind int, a long, b long")


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, together: int = TOGETHER) -> DataFrame:
    """Edges (a, b) that connect just those of the distinct fingerprints fps (fp) that at most `distance` bits apart connect.

    A key is blocks - distance blocks: 32 of 64 bits by default, so unlike
    fingerprints hardly meet. A key that over `together` fingerprints share is
    split by parts of its other bits, and what is still larger into chunks that
    meet in pairs, each pair in a task of its own: exact at any size, without a
    row for each pair.
    """
    keyed = fps.select("fp").mapInArrow(partial(_keyed, blocks=blocks, distance=distance), "key long, fp long")
    found = materialise(_join(keyed, distance, together), "links")
    edges = found.where("kind = 0").select("a", "b")
    if found.where("kind = 1").isEmpty():
        return edges
    large = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    finer = large.mapInArrow(partial(_finer, blocks=blocks, distance=distance), "key long, sub long, fp long")
    found = materialise(_join(finer.select(F.xxhash64("key", "sub").alias("key"), "fp"), distance, together), "finer-links")
    edges = edges.unionByName(found.where("kind = 0").select("a", "b"))
    if found.where("kind = 1").isEmpty():
        return edges
    large = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    counts = large.groupBy("key").agg(F.ceil(F.count("*") * 2 / together).cast("int").alias("n"))
    chunked = large.join(counts, "key").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = chunked.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp")
    return edges.unionByName(_join(pairs, distance, None).select("a", "b"))


def near_duplicates(df: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document (doc_id, text).

    Documents are linked when their fingerprints differ in at most `distance`
    bits; component_id is the smallest doc_id that links reach. Documents
    without a word (null, empty, blank) have fingerprint 0 and are linked like
    others. Equal fingerprints count once in the search, so copies cost no
    pairs; repeated rows are kept. No rows give no rows; a null doc_id has a
    component_id like any other and is never one unless all are null.
    """
    return _grouped(df, words, distance, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(df: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp, root, component_id) of each document; root is one fingerprint of its group, the same for all of it."""
    own = materialise(fingerprints(df, words, seed), "fingerprints")
    distinct = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = materialise(connected_components(links(distinct, distance)), "components")
    joined = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    table = joined.join(least, "root").select("fp", "root", "component_id")
    return own.join(table, "fp").select("doc_id", "fp", "root", "component_id")


def without_near_duplicates(df: DataFrame, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """df without all but the first document, by doc_id, of each group.

    Where rows share that doc_id the one with the smallest fingerprint stays, of
    those with equal fingerprints the one whose text has the smallest hash;
    unlike texts of different groups under one doc_id stay both. Texts are
    shuffled once, by doc_id, at every size; only ids are held in memory.
    """
    groups = _grouped(df, words, distance, seed).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    name, mark = fresh(df.columns, "_id"), fresh(df.columns, "_fp")
    stay = materialise(groups.groupBy(F.col("doc_id").alias(name), "root").agg(F.min("fp").alias(mark), F.count("*").alias("rows")), "kept")
    once = df.join(stay.select(name).distinct().hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_semi")
    if stay.where("rows > 1").isEmpty() and stay.groupBy(name).count().where("count > 1").isEmpty():
        return once

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(x, words, seed) for x in text_bytes(b.column("text"))], "u8")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.view("i8"))], [*b.schema.names, mark])

    full, row, other = once.mapInArrow(told, StructType([*df.schema.fields, StructField(mark, LongType())])), fresh([*df.columns, mark], "_row"), fresh([*df.columns, mark], "_mark")
    chosen = stay.select(name, F.col(mark).alias(other))
    full = full.join(chosen, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(mark) == F.col(other)), "left_semi")
    order = Window.partitionBy("doc_id", mark).orderBy(F.xxhash64("text"))
    return full.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row, mark)
