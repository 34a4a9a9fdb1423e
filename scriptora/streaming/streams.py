"""Structured Streaming: gated batches, running profiles and scoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scriptora.operators import corpus, ensemble, profiles


def read_corpus(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def interleaved(streams: Mapping[str, DataFrame]) -> DataFrame:
    """The streams of several languages as one, each row with its language; stream_batches with a seed mixes them within a trigger."""
    out = None
    for lang, stream in streams.items():
        one = stream.withColumn("lang", F.lit(lang))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no streams")
    return out


def stream_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, batch_size: int = 256, seed: int | None = None) -> StreamingQuery:
    """Every accepted row once, in batches of at most batch_size: handle gets each trigger's rows with `batch`; seed shuffles within a trigger."""
    gated = corpus.quality_gate(stream)

    def numbered(df: DataFrame, epoch: int) -> None:
        rows = df.rdd.getNumPartitions()  # batches are cut within partitions, so nothing is gathered
        own = df.withColumn("_o", corpus.seeded(seed) if seed is not None else F.lit("")).sortWithinPartitions("_o").drop("_o")
        part, place = F.shiftright(F.monotonically_increasing_id(), 33), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
        handle(own.withColumn("batch", (F.floor(place / batch_size) * rows + part).cast("long")), epoch)

    return gated.writeStream.foreachBatch(numbered).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def token_counts(stream: DataFrame, kind: str = "word") -> DataFrame:
    """Running (lang, token, n) of words, letters, bigrams or trigrams; state is one row a token of a language. Write in complete or update mode."""
    raw = profiles.documents(stream, registry_only=False)
    if kind == "char":
        from scriptora.functions import characters as C

        one = raw.select("lang", F.explode(F.filter(C.tally(F.col("text")), lambda x: C.is_letter(x["c"]))).alias("x")).select("lang", F.col("x.c").alias("token"), F.col("x.n").alias("n"))
    else:
        from scriptora.functions import characters as C
        from scriptora.functions.classes import WORD_EDGE

        words = raw.select("lang", F.explode(C.words(F.col("text"))).alias("token"))
        if kind == "word":
            one = words.select("lang", F.btrim("token", F.lit(WORD_EDGE)).alias("token")).where(F.length("token") >= 2)
        else:
            n = {"bigram": 2, "trigram": 3}[kind]
            one = words.where(F.length("token") >= n).select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - (n - 1)), lambda k: F.substring(F.col("token"), k, F.lit(n)))).alias("token"))
        one = one.withColumn("n", F.lit(1).cast("long"))
    return one.groupBy("lang", "token").agg(F.sum("n").alias("n"))


def length_histogram(stream: DataFrame) -> DataFrame:
    """Running (lang, len, n): what medians and means of a stream come from."""
    return profiles.documents(stream, registry_only=False).groupBy("lang", F.length("text").alias("len")).agg(F.count("*").alias("n"))


def score(stream: DataFrame, scorers: Mapping[str, ensemble.Scorer] | None = None) -> DataFrame:
    """Predictions row by row; no state."""
    return ensemble.predict(stream, scorers)
