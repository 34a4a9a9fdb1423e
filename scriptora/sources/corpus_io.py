"""Sources and sinks of corpora, profiles, metrics, training lines and raw text."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.functions import registry as R
from scriptora.functions.characters import once
from scriptora.functions.cleaning import one_line, preprocess
from scriptora.operators import corpus

SCHEMA = "text string, lang string, label int, doc_id string, n_id string, text_len int"


def load_languages(spark: SparkSession, path: str, languages: list[str] | None = None, max_per_lang: int | None = None, balance: bool = True, seed: int = 42, shuffle: bool = True) -> DataFrame:
    """The labelled corpus under path (parquet, with lang, text, doc_id): gate, labels, at most so many rows a language, balanced, shuffled.

    Languages are pruned at the scan. Raises where none of them has rows.
    """
    df = spark.read.parquet(path).where(F.col("lang").isin(languages or R.CODES))
    df = corpus.quality_gate(df).withColumn("label", F.coalesce(R.lookup(F.col("lang"), 4), F.lit(-1)))
    if df.isEmpty():
        raise ValueError("no rows of these languages")
    if max_per_lang:
        df = corpus.first_per_language(df, max_per_lang, seed=seed)
    df = corpus.balanced(df, seed=seed) if balance else df
    return corpus.shuffled(df, seed) if shuffle else df


def load_language_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """The union of one table a language (parquet with text and doc_id), each labelled with its language."""
    out = None
    for lang, path in paths.items():
        one = spark.read.parquet(path).select("text", F.col("doc_id").cast("string").alias("doc_id")).withColumn("lang", F.lit(lang))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def cached(spark: SparkSession, folder: str, build: Callable[[], DataFrame], **key: object) -> DataFrame:
    """What build gives, kept as parquet under folder by every part of the key; a table that was not written to its end is built anew."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


class Memo:
    """Loads of one session by key: each is persisted the first time and given back afterwards."""

    def __init__(self) -> None:
        self.held: dict[str, DataFrame] = {}

    def get(self, build: Callable[[], DataFrame], **key: object) -> DataFrame:
        name = json.dumps(key, sort_keys=True, default=str)
        if name not in self.held:
            self.held[name] = build().persist()
        return self.held[name]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


def load_alignable(spark: SparkSession, path: str, max_samples: int | None = None) -> DataFrame:
    """Rows that pass the gate with lang (unk if missing) and label (-1 if unknown)."""
    df = spark.read.parquet(path)
    lang = F.coalesce(F.col("lang"), F.lit("unk")) if "lang" in df.columns else F.lit("unk")
    df = corpus.quality_gate(df.withColumn("lang", lang)).select("text", "lang", F.coalesce(R.lookup(F.col("lang"), 4), F.lit(-1)).alias("label"), F.col("doc_id").cast("string").alias("doc_id"))
    return df.orderBy("doc_id").limit(max_samples) if max_samples else df


def write_splits(df: DataFrame, path: str) -> None:
    """One folder a split: split=train, split=val, split=test."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).drop("split")


def write_json(df: DataFrame, path: str) -> None:
    """Profiles, metrics or results, one object a line, UTF-8 as it is."""
    df.write.mode("overwrite").json(path)


def fasttext_lines(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    return df.select(F.concat(F.lit("__label__"), F.col(lang), F.lit(" "), one_line(F.coalesce(F.col(text), F.lit("")))).alias("line"))


def write_fasttext(df: DataFrame, path: str) -> None:
    fasttext_lines(df).write.mode("overwrite").text(path)


def read_lines(df: DataFrame, raw: str = "value", limit: int = 50) -> DataFrame:
    """The first non-empty trimmed lines of each raw text: (line_no, text)."""
    lines = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.btrim(x)), lambda x: x != "")
    return df.select(F.posexplode(F.slice(lines, 1, limit)).alias("line_no", "text"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: value."""
    return spark.read.text(path, wholetext=True)


def cleaned(df: DataFrame, text: str = "text", min_len: int = 30) -> DataFrame:
    """Texts after preprocessing, those of min_len or more."""
    other = [c for c in df.columns if c != text]
    return df.select(*other, once(preprocess(F.col(text))).alias(text)).where(F.length(text) >= min_len).select(*df.columns)
