"""Corpus preparation: filters, statistics, balanced samples, splits and orders that repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions import registry as R
from scriptora.functions.classes import LETTER
from scriptora.functions.cleaning import strip


def passes(text: Column, min_len: int = 50, min_alpha: float = 0.4) -> Column:
    """The quality gate: length and share of letters of the stripped text."""
    bare = strip(F.coalesce(text, F.lit("")))
    return (F.length(bare) >= min_len) & (F.length(F.regexp_replace(bare, f"[^{LETTER}]+", "")) / F.greatest(F.length(bare), F.lit(1)) >= min_alpha)


def quality_gate(df: DataFrame, text: str = "text", min_len: int = 50, max_len: int = 2000) -> DataFrame:
    """Rows that pass; text is cut to max_len, text_len tells the length before."""
    return df.where(passes(F.col(text), min_len)).withColumn("text_len", F.length(text)).withColumn(text, F.substring(text, 1, max_len))


def seeded(seed: int, key: str = "doc_id") -> Column:
    """An order that every run and engine repeats."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def shuffled(df: DataFrame, seed: int = 42, key: str = "doc_id") -> DataFrame:
    return df.orderBy(seeded(seed, key), key)


def dataset_stats(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per language: rows, lengths (the mean of text_len where the table has it) and different ids."""
    size = F.length(text)
    mean = F.col("text_len") if "text_len" in df.columns else size
    out = df.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n_samples"), F.avg(mean).alias("avg_len"), F.min(size).cast("long").alias("min_len"), F.max(size).cast("long").alias("max_len"), F.countDistinct(key).alias("unique_docs"))
    return out.select("lang", R.name_of(F.col("lang")).alias("name"), F.coalesce(R.lookup(F.col("lang"), 2), F.lit("?")).alias("script"), "n_samples", "avg_len", "min_len", "max_len", "unique_docs")


def first_per_group(df: DataFrame, group: str, sizes: DataFrame, seed: int = 42, key: str = "doc_id", rows_per_task: int = 200_000) -> DataFrame:
    """The rows of each group that come first in the seeded order, as many as sizes (group, take) says, with their place `_rank`.

    Counts by group and leading digits of the order say which slice of each
    group the last row lies in; rank within a slice is added to what comes
    before it. A group may hold most of the table.
    """
    ordered = df.withColumn("_o", seeded(seed, key))
    digits = 3
    sliced = ordered.withColumn("_slice", F.substring("_o", 1, digits))
    counts = sliced.groupBy(group, "_slice").count()
    before = counts.select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), (F.sum("count").over(Window.partitionBy(group).orderBy("_slice")) - F.col("count")).alias("_before"))
    wanted = before.join(sizes.select(F.col(group).alias("_h"), "take"), F.col("_g").eqNullSafe(F.col("_h"))).where("_before < take").drop("_h")
    near = sliced.join(F.broadcast(wanted), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_slice") == F.col("_s")))  # at most 4096 rows a group
    ranked = near.withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy(group, "_slice").orderBy("_o", key)))
    return ranked.where("_rank <= take").select(*df.columns, "_rank", "take")


def balanced(df: DataFrame, lang: str = "lang", seed: int = 42, key: str = "doc_id") -> DataFrame:
    """Each language cut to as many rows as the smallest has."""
    counts = df.groupBy(lang).count()
    sizes = counts.crossJoin(F.broadcast(counts.agg(F.min("count").alias("take")))).select(lang, "take")  # one row a language, times one
    return first_per_group(df, lang, sizes, seed, key).drop("_rank", "take")


def first_per_language(df: DataFrame, n: int, lang: str = "lang", seed: int = 42, key: str = "doc_id") -> DataFrame:
    """At most n rows of each language."""
    return first_per_group(df, lang, df.select(lang).distinct().withColumn("take", F.lit(n)), seed, key).drop("_rank", "take")


def split(df: DataFrame, lang: str = "lang", val: float = 0.05, test: float = 0.1, seed: int = 42, key: str = "doc_id") -> DataFrame:
    """df with `split` (test, val, train), exact shares of each language; val is drawn from what test leaves."""
    counts = df.groupBy(lang).count()
    sizes = counts.select(F.col(lang).alias("_l"), F.round(F.col("count") * test).cast("long").alias("_test"), F.round((F.col("count") - F.round(F.col("count") * test)) * (val / (1 - test))).cast("long").alias("_val"))
    every = first_per_group(df, lang, counts.withColumnRenamed("count", "take"), seed, key)
    placed = every.join(F.broadcast(sizes), F.col(lang).eqNullSafe(F.col("_l")))
    name = F.when(F.col("_rank") <= F.col("_test"), "test").when(F.col("_rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train")
    return placed.withColumn("split", name).drop("_rank", "take", "_l", "_test", "_val")
