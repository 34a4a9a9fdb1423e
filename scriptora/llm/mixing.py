"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.llm.common import compact, fresh, materialise, text_bytes

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5, 2, 1), 1.5, 2, 17


def water_fill(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what a clamped source leaves goes to the others by weight."""
    target, open_, rest = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        level = rest / sum(weights[k] for k in open_)
        over = [k for k in open_ if weights[k] * level > most * sizes[k]]
        for k in over or open_:
            target[k] = float(most * sizes[k]) if over else weights[k] * level
        if not over:
            break
        rest -= sum(target[k] for k in over)
        open_ = [k for k in open_ if k not in set(over)]
    return target


def measured(df: DataFrame) -> DataFrame:
    """(doc_id, source, size) with the number of words, from one pass over the whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("size", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), pa.array([len(x.split()) for x in text_bytes(b.column(2))], pa.int64())], schema=schema)

    return compact(df.select(F.col("doc_id").cast("long"), "source", "text")).mapInArrow(count, "doc_id long, source string, size long")


def _order(seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))


def mixture(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS, seed: int = SEED, rows_per_task: int = 50_000) -> dict[str | None, dict]:
    """What each source gives, from a written table (doc_id, source, size): one entry for each source.

    Keys: size, target, whole (repetitions that every document has), and for
    the fractional one: docs with an order below `order` are taken whole, those
    at it share `part` words. Order is by md5 of seed and doc_id. The word sums
    that find the place are by source and leading hex digits of the order; only
    the one slice of each source in which its fraction ends is sorted. A
    source's size may be nearly the whole table's.
    """
    slices = sizes.withColumn("_o", _order(seed))
    totals = {r["source"]: (r["size"], r["rows"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    names = sorted((k for k in totals if k is not None)) + [None] * (None in totals)
    own = [totals[k][0] for k in names]
    targets = water_fill(own, [weights[k % len(weights)] for k in range(len(names))], share * sum(own), most)
    out = {k: {"size": n, "target": t, "whole": most if t >= most * n and n else int(t // n) if n else 0, "order": "", "part": 0, "group": 1} for k, n, t in zip(names, own, targets, strict=True)}
    for x in out.values():
        x["rest"] = max(0, round(x["target"]) - x["whole"] * x["size"])
    digits = max(1, math.ceil(math.log(max(1, sum(n for _, n in totals.values()) / rows_per_task), 16)))
    spark = sizes.sparkSession
    rest = spark.createDataFrame([(k, x["rest"]) for k, x in out.items()], "_source string, _rest long") if out else None
    if rest is None:
        return out
    slices = slices.withColumn("_slice", F.substring("_o", 1, digits))
    sums = slices.groupBy("source", "_slice").agg(F.sum("size").alias("n"))
    by_slice = Window.partitionBy("source").orderBy("_slice")
    sums = sums.withColumn("_before", F.sum("n").over(by_slice) - F.col("n"))
    edge = sums.join(F.broadcast(rest), F.col("source").eqNullSafe(F.col("_source"))).where("_before < _rest and _rest <= _before + n").select("_source", F.col("_slice").alias("_edge"), (F.col("_rest") - F.col("_before")).alias("_rest"))
    near = slices.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_edge"))).groupBy("_source", "_o").agg(F.sum("size").alias("n"), F.first("_rest").alias("_rest"))
    near = near.withColumn("_before", F.sum("n").over(Window.partitionBy("_source").orderBy("_o")) - F.col("n"))
    for r in near.where("_before < _rest and _rest <= _before + n").collect():
        out[r["_source"]] |= {"order": r["_o"], "part": r["_rest"] - r["_before"], "group": r["n"]}
    return out


def mix(df: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of each document (doc_id, source, text).

    Null texts have no words; null is a source of its own, the last. A source
    without words has target 0. Repeated rows are documents of their own; those
    that share the place where a fraction ends share its words. No rows give
    no rows. A source is a collection's name, so the driver can hold one row
    for each.
    """
    sizes = materialise(measured(df), "words")
    found = mixture(sizes, **how)
    seed = how.get("seed", SEED)
    rows = [(k, x["size"], x["target"], x["whole"], x["order"], x["part"], x["group"]) for k, x in found.items()]
    table = df.sparkSession.createDataFrame(rows, "_source string, source_size long, target double, _whole long, _edge string, _part long, _group long")
    more = F.when(F.col("_o") < F.col("_edge"), F.col("size")).when(F.col("_o") == F.col("_edge"), F.expr("size * _part div _group")).otherwise(0)
    return (
        sizes.withColumn("_o", _order(seed)).join(F.broadcast(table), F.col("source").eqNullSafe(F.col("_source")))
        .select("doc_id", "size", "source_size", "target", (F.col("_whole") * F.col("size") + more).cast("long").alias("taken"))
    )


def mixed_documents(df: DataFrame, **how) -> DataFrame:
    """The documents as the mix takes them, with df's columns: a row for each whole repetition, and the first words of a fractional one.

    The cut keeps the text's own white space; where it falls is what mix calls
    taken. One column named n_chars, where df has it, follows the cut texts.
    """
    found, seed = mixture(materialise(measured(df), "words"), **how), how.get("seed", SEED)
    names, schema, place = df.columns, df.schema, fresh(df.columns, "_o")

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cut = [], []
            for k, (source, order, text) in enumerate(zip(b.column("source").to_pylist(), b.column(place).to_pylist(), text_bytes(b.column("text")), strict=True)):
                x = found[source]
                take += [k] * (x["whole"] + (order < x["order"]))
                if order == x["order"] and x["part"]:
                    words = text.split()
                    if n := len(words) * x["part"] // x["group"]:
                        if n == len(words):
                            take.append(k)
                        else:
                            cut.append((k, text[: next(islice(re.finditer(rb"\S+", text), n - 1, None)).end()].decode()))
            if take:
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(take)) for c in names], names)
            for k, text in cut:
                row = b.slice(k, 1)
                yield pa.RecordBatch.from_arrays([pa.array([text]) if c == "text" else pa.array([len(text)], row.column(c).type) if c == "n_chars" else row.column(c) for c in names], names)

    return compact(df.withColumn(place, _order(seed))).mapInArrow(repeat, schema)
