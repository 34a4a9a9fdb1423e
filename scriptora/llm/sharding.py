"""Shards of near-equal size: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import materialise

#: Atomic groups: equal texts fall into the same of 2**18 buckets, whose total sizes are all that the driver sees.
BUCKET_BITS = 18


def capacity(ends: np.ndarray, start: int, shards: int) -> int:
    """The smallest capacity with which the groups from start on fit into so many shards, by binary search; ends holds the sizes' running sums from 0 on."""

    def fits(most: int) -> bool:
        at = start
        for _ in range(shards):
            at = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
            if at == len(ends) - 1:
                return True
        return False

    low, high = int(np.diff(ends[start:]).max(initial=0)), int(ends[-1] - ends[start])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def cut_points(sizes: np.ndarray, shards: int) -> np.ndarray:
    """Where shards start in the ordered groups: no shard is over the smallest feasible capacity.

    Shard by shard, the smallest feasible capacity of what is left is found; a
    greedy check tells how little this shard may take so that the rest still
    fits, and the cut goes where, between that and the capacity, the shard
    comes nearest to an equal share of what is left. So a group larger than a
    share fills its own shard and the others stay even. While groups are left a
    shard takes at least one.
    """
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    cuts, start, n = [0], 0, len(sizes)
    for k in range(1, shards):
        left, most = shards - k, capacity(ends, start, shards - k + 1)
        last = int(np.searchsorted(ends, ends[start] + most, "right")) - 1
        first = n
        for _ in range(left):  # the greedy check from the end: what the other shards can hold at most
            first = int(np.searchsorted(ends, ends[first] - most, "left"))
        first = min(max(first, start + 1), last, n)
        share = ends[start] + (ends[-1] - ends[start]) / (left + 1)
        at = int(np.searchsorted(ends, share))
        at = at - 1 if at > 0 and (at > n or share - ends[at - 1] <= ends[at] - share) else at
        cuts.append(min(max(at, first), last))
        start = cuts[-1]
    return np.array(cuts)


def mixed_order(sizes: np.ndarray, shards: int, orders: int = 64, seed: int = 29) -> np.ndarray:
    """An order of the groups (given largest first) that mixes sizes: of some seeded ones the one with the smallest feasible capacity.

    Groups at least as large as a share of what follows come first. The others
    are dealt by rank over lanes, as many as shards remain, each lane getting
    one of every so many, to and fro or at random; a lane rises from its small
    groups to its large ones and falls again, so small groups lie where cuts
    will fall.
    """
    giants, rest = 0, int(sizes.sum())
    while giants < min(len(sizes), shards - 1) and sizes[giants] * (shards - giants) >= rest:
        rest -= int(sizes[giants])
        giants += 1
    lanes, draw, best = shards - giants, np.random.default_rng(seed), None
    turn = np.arange(len(sizes) - giants) // lanes
    turns = int(turn[-1]) + 1 if len(turn) else 0
    side = turn // 2 % 2  # rising, then falling; a late turn has small groups
    for k in range(orders if turns else 0):
        dealt = draw.permuted(np.tile(np.arange(lanes), (turns, 1)), axis=1) if k else np.where(np.arange(turns)[:, None] % 2 == 0, np.arange(lanes), np.arange(lanes)[::-1])
        order = np.lexsort((np.where(side == 0, -turn, turn), side, dealt.ravel()[: len(turn)]))
        least = capacity(np.concatenate([[0], np.cumsum(sizes[giants:][order])]), 0, lanes)
        if best is None or least < best[0]:
            best = least, order
    return np.concatenate([np.arange(giants), giants + best[1]]) if best else np.arange(giants)


def _sized(df: DataFrame, *more: str) -> DataFrame:
    """doc_id, size, text_crc32 and _bucket of each document, and further columns of df."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bucket = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return df.select(F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftright(bucket, 32 - BUCKET_BITS).cast("int").alias("_bucket"), *more)


def _shards(sized: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """(_bucket, shard), at most 2**BUCKET_BITS rows, and the number of documents."""
    totals = sized.groupBy("_bucket").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).toPandas()  # at most 2**BUCKET_BITS rows
    totals = totals.sort_values(["size", "_bucket"], ascending=[False, True], kind="stable")
    totals = totals.iloc[mixed_order(totals["size"].to_numpy("i8"), shards)]
    shard = np.searchsorted(cut_points(totals["size"].to_numpy("i8"), shards), np.arange(len(totals)), "right") - 1
    table = pd.DataFrame({"_bucket": totals["_bucket"].to_numpy("i4"), "shard": shard.astype("i4")})
    return sized.sparkSession.createDataFrame(table, "_bucket int, shard int"), int(totals["rows"].sum())


def _slotted(sized: DataFrame, table: DataFrame, rows: int, rows_per_task: int) -> DataFrame:
    """sized with shard and slot."""
    chunks = max(1, -(-rows // rows_per_task))
    dealt = sized.join(F.broadcast(table), "_bucket").withColumn("_chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)))  # a bounded table
    before = dealt.groupBy("shard", "_chunk").count()
    before = before.select("shard", "_chunk", (F.sum("count").over(Window.partitionBy("shard").orderBy("_chunk")) - F.col("count")).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_chunk").orderBy("doc_id", "text_crc32")) - 1)
    return ranked.join(before, ["shard", "_chunk"]).withColumn("slot", (F.col("_rank") + F.col("_before")).cast("long"))


def shard_by_bytes(df: DataFrame, shards: int = 24, rows_per_task: int = 50_000) -> DataFrame:
    """Puts each document (doc_id, text) into a shard; the shards' bytes are near equal.

    Size: UTF-8 bytes of the text and 8 more; null texts have those 8 and stay
    with the empty ones. Equal texts are atomic: the atoms are hash buckets of
    them, in an order that mixes sizes, and the smallest feasible capacity
    decides where that order is cut. slot numbers a shard's documents from 0
    without gaps, in an order by chunk and doc_id; chunks keep each task to
    about rows_per_task rows even where one group holds a third of the table.
    Repeated rows have slots of their own.
    """
    sized = materialise(_sized(df), "sizes")
    out = _slotted(sized, *_shards(sized, shards), rows_per_task)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(df: DataFrame, path: str, shards: int = 24, rows_per_task: int = 50_000) -> None:
    """Writes each document's doc_id, text and slot under path/shard=N, in slot order within each file; repeated rows have slots of their own.

    Large shards become several files: rows are dealt to writers by shard and
    slot, and a file closes at a bounded number of rows.
    """
    table, rows = _shards(materialise(_sized(df), "sizes"), shards)
    full = _slotted(_sized(df, "text"), table, rows, rows_per_task).select("doc_id", "text", "shard", "slot")
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("maxRecordsPerFile", 1_000_000).parquet(path)
