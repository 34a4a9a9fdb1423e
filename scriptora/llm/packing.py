"""Best-fit packing of token sequences by large-item matching on the histogram of lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from scriptora.llm.common import batched, compact, materialise, text_bytes
from scriptora.llm.tokens import encoder

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` tokens of each document of df (doc_id, text), whose ids end in end_id.

    Null and empty texts have the end id alone. Only longer documents are cut;
    all their pieces but the last are full.
    """
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity
    schema = PIECES if with_ids else PIECES.remove(5)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids = encode(text) + end
                for k, at in enumerate(range(0, len(ids), width)):
                    own = ids[at : at + width]
                    yield (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own)[: len(schema)]

    weigh = (lambda row: len(row[5])) if with_ids else None
    spark_schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return compact(df.select(F.col("doc_id").cast("long"), "text")).mapInArrow(lambda b: batched(rows(b), schema, weigh=weigh), spark_schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where the items of each length go: (length, first rank, items, first sequence, offset) puts items first rank + k into sequence first + k.

    Items over a third of the capacity fit at most two to a sequence: from the
    largest down each is matched with the largest that fits beside it, which
    gives the most pairs. Shorter items then go, longest first, into the
    smallest gap that holds them. Sequences with equal contents are handled as
    one range, so work and memory depend on the number of lengths, not of items.
    """
    left, placed, sequences = {k: v for k, v in counts.items() if v}, [], 0
    rank: dict[int, int] = defaultdict(int)
    gaps: list[int] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(length: int, n: int, first: int, offset: int) -> None:
        placed.append((length, rank[length], n, first, offset))
        rank[length] += n

    def keep(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not ranges[gap]:
                insort(gaps, gap)
            ranges[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        length = large[-1]
        n = left[length]
        at = bisect_right(large, capacity - length) - 1
        mate = large[at] if at >= 0 else None
        if mate == length and n == 1:
            mate = large[at - 1] if at else None
        if mate == length:
            n //= 2
            put(length, n, sequences, 0)
            put(length, n, sequences, length)
            left[length] -= 2 * n
        else:
            n = min(n, left[mate]) if mate else n
            put(length, n, sequences, 0)
            left[length] -= n
            if mate:
                put(mate, n, sequences, length)
                left[mate] -= n
                if not left[mate]:
                    large.remove(mate)
        if not left[length]:
            large.pop()
        keep(capacity - length - (mate or 0), sequences, n)
        sequences += n

    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                opened = -(-n // (capacity // length))
                keep(capacity, sequences, opened)
                sequences += opened
                continue
            gap = gaps[at]
            first, size = ranges[gap].pop()
            used = min(n, size)
            put(length, used, first, capacity - gap)
            n -= used
            if size > used:
                ranges[gap].append((first + used, size - used))
            elif not ranges[gap]:
                gaps.pop(at)
            keep(gap - length, first, used)
    return placed


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_task: int = 100_000) -> DataFrame:
    """pieces (a written table with doc_id, piece, length) with sequence_id and offset.

    The histogram of lengths, at most `capacity` rows, is all that reaches the
    driver. An item's rank among those of its length comes from counts by
    length and chunk, chunks having about rows_per_task rows, so a length that
    very many documents share is ranked in many tasks. Repeated rows are packed
    each for itself. No pieces give no rows.
    """
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    placed = sorted(plan(counts, capacity))
    base = max(counts.values(), default=0) + 1
    keys, first_rank, first, offset = (np.array(x, "i8") for x in zip(*((p[0] * base + p[1], p[1], p[3], p[4]) for p in placed), strict=True)) if placed else (np.zeros(0, "i8"),) * 4
    where = pieces.sparkSession.sparkContext.broadcast((keys, first_rank, first, offset))
    chunks = max(1, -(-sum(counts.values()) // rows_per_task))
    dealt = pieces.withColumn("_chunk", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(chunks)))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_chunk").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    before = dealt.groupBy("length", "_chunk").count()
    before = before.select("length", "_chunk", (F.sum("count").over(Window.partitionBy("length").orderBy("_chunk")) - F.col("count")).alias("_before"))
    numbered = ranked.join(before, ["length", "_chunk"]).select(*pieces.columns, (F.col("_rank") + F.col("_before")).alias("_rank"))

    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first_rank, first, offset = where.value
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, b.column("length").to_numpy(zero_copy_only=False) * base + rank, "right") - 1
            columns = [b.column(c) for c in names] + [pa.array(first[at] + rank - first_rank[at], pa.int64()), pa.array(offset[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]))


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Packs all documents (doc_id, text) into sequences of at most `capacity` tokens: a row for each piece, with its ids on request."""
    return pack(materialise(cut_pieces(df, tokenizer, end_id, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids array<int>) of pieces packed with_ids; a sequence has at most the capacity's tokens."""
    @F.pandas_udf("array<int>")
    def joined(parts):
        return parts.map(lambda own: np.frombuffer(b"".join(x["ids"] for x in own), "<u4").astype("i4"))

    return packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts")).select("sequence_id", joined("_parts").alias("ids"))
