"""Language profiles: frequencies of characters, words and n-grams, vocabulary richness, similarity of languages.

Counts are long tables (lang, token, n), combined before each shuffle. N-grams
are counted from word counts, so a word's n-grams are cut once for each
different word of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions import characters as C
from scriptora.functions import registry as R
from scriptora.functions.classes import WORD_EDGE


def documents(df: DataFrame, registry_only: bool = True, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, text) of non-empty texts; registry_only drops unknown languages."""
    own = df.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("text") != "")
    return own.where(F.col("lang").isin(R.CODES)) if registry_only else own


def char_counts(docs: DataFrame) -> DataFrame:
    """Letters by language; each row sends one count for each of its different letters."""
    one = docs.select("lang", F.explode(F.filter(C.tally(F.col("text")), lambda x: C.is_letter(x["c"]))).alias("x"))
    return one.groupBy("lang", F.col("x.c").alias("token")).agg(F.sum("x.n").alias("n"))


def raw_word_counts(docs: DataFrame) -> DataFrame:
    return docs.select("lang", F.explode(C.words(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))


def word_counts(raw: DataFrame) -> DataFrame:
    """Words without punctuation at their ends, of two or more characters."""
    bare = raw.select("lang", F.btrim("token", F.lit(WORD_EDGE)).alias("token"), "n").where(F.length("token") >= 2)
    return bare.groupBy("lang", "token").agg(F.sum("n").alias("n"))


def ngram_counts(raw: DataFrame, n: int) -> DataFrame:
    """Character n-grams inside raw words."""
    grams = F.transform(F.sequence(F.lit(1), F.length("token") - (n - 1)), lambda k: F.substring(F.col("token"), k, F.lit(n)))
    return raw.where(F.length("token") >= n).select("lang", F.explode(grams).alias("token"), "n").groupBy("lang", "token").agg(F.sum("n").alias("n"))


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k most frequent tokens of each language; ties by token."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "token"))).where(F.col("rank") <= k)


def stats(docs: DataFrame, with_tops: bool = True) -> DataFrame:
    """One row a language: seventeen fields, the largest languages first by sort of the caller.

    The median comes from a histogram of lengths, which merges over tasks and
    streams alike.
    """
    raw = raw_word_counts(docs)
    words, chars = word_counts(raw), char_counts(docs)
    lengths = docs.groupBy("lang", F.length("text").alias("len")).agg(F.count("*").alias("k"))
    by = Window.partitionBy("lang").orderBy("len")
    placed = lengths.withColumn("upto", F.sum("k").over(by)).withColumn("all", F.sum("k").over(Window.partitionBy("lang")))
    half = lambda at: F.min(F.when(F.col("upto") >= at, F.col("len")))
    text = placed.groupBy("lang").agg(F.max("all").alias("n_documents"), (F.sum(F.col("len") * F.col("k")) / F.sum("k")).alias("avg"), ((half(F.floor((F.col("all") + 1) / 2)) + half(F.floor(F.col("all") / 2) + 1)) / 2).alias("median"))
    letters = chars.groupBy("lang").agg(F.sum("n").alias("total_chars"), (F.log2(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log2(F.col("n").cast("double"))) / F.sum("n")).alias("h"))
    word = words.groupBy("lang").agg(F.sum("n").alias("total_words"), F.count("*").alias("vocab_size"), F.sum((F.col("n") == 1).cast("int")).alias("hapax"), F.sum(F.length("token") * F.col("n")).alias("chars"))
    out = text.join(letters, "lang", "left").join(word, "lang", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select(
        "lang", R.name_of(F.col("lang")).alias("name"), F.coalesce(R.lookup(F.col("lang"), 2), F.lit("?")).alias("script"), "n_documents", zero("total_chars").cast("long").alias("total_chars"), zero("total_words").cast("long").alias("total_words"), zero("vocab_size").cast("long").alias("vocab_size"),
        F.round(zero("vocab_size") / F.greatest(zero("total_words"), F.lit(1)), 4).alias("ttr"), F.round(zero("hapax") / F.greatest(zero("vocab_size"), F.lit(1)), 4).alias("hapax_ratio"), F.round(F.coalesce("h", F.lit(0.0)), 4).alias("char_entropy"),
        F.round("avg", 1).alias("avg_text_len"), F.round(F.when(zero("total_words") > 0, F.col("chars") / F.col("total_words")).otherwise(0.0), 2).alias("avg_word_len"), F.round("median", 1).alias("median_text_len"),
    )
    if with_tops:
        for name, counts, k in (("top_chars", chars, 20), ("top_words", words, 30), ("top_bigrams", ngram_counts(raw, 2), 20), ("top_trigrams", ngram_counts(raw, 3), 20)):
            best = top(counts, k).groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("rank", "token", "n"))).alias("x"))
            best = best.select("lang", F.map_from_entries(F.transform("x", lambda e: F.struct(e["token"], e["n"]))).alias(name))
            out = out.join(best, "lang", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,bigint>")))
    return out


def richness(words: DataFrame) -> DataFrame:
    """Vocabulary, tokens, type-token ratio, Guiraud, Herdan and Yule's K of each language with words."""
    own = words.groupBy("lang").agg(F.count("*").alias("V_vocab"), F.sum("n").alias("N_tokens"), F.sum(F.col("n").cast("double") * F.col("n")).alias("m2"))
    v, n = F.col("V_vocab").cast("double"), F.col("N_tokens").cast("double")
    return own.select("lang", R.name_of(F.col("lang")).alias("name"), "V_vocab", "N_tokens", (v / n).alias("ttr"), (v / F.sqrt(n)).alias("guiraud"), F.when(n > 1, F.log(v) / F.log(n)).otherwise(0.0).alias("herdan"), yule_k(n, F.col("m2")).alias("yule_k"))


def yule_k(m1: Column, m2: Column) -> Column:
    return F.when(m1 > 0, 1e4 * (m2 - m1) / (m1 * m1)).otherwise(0.0)


def similarity(bigrams: DataFrame) -> DataFrame:
    """(lang1, lang2, sim) of every pair of languages: cosine of bigram counts, 0 where nothing is shared.

    Pairs come from the bigrams that two languages share; a bigram is in at
    most as many rows as there are languages.
    """
    x = bigrams.select("token", F.col("lang").alias("lang1"), F.col("n").cast("double").alias("n1"))
    y = bigrams.select("token", F.col("lang").alias("lang2"), F.col("n").cast("double").alias("n2"))
    dots = x.join(y, "token").groupBy("lang1", "lang2").agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    norms = x.groupBy("lang1").agg(F.sqrt(F.sum(F.col("n1") * F.col("n1"))).alias("norm1"))
    langs = norms.agg(F.collect_set("lang1").alias("langs"))  # one name a language
    grid = norms.join(F.broadcast(langs)).withColumn("lang2", F.explode("langs")).drop("langs")
    grid = grid.join(norms.select(F.col("lang1").alias("lang2"), F.col("norm1").alias("norm2")), "lang2")
    return grid.join(dots, ["lang1", "lang2"], "left").select("lang1", "lang2", F.coalesce(F.col("dot") / (F.col("norm1") * F.col("norm2")), F.lit(0.0)).alias("sim"))


def similarity_matrix(sims: DataFrame, digits: int = 4) -> DataFrame:
    """The same as a square table for display, the diagonal left out."""
    return sims.where("lang1 <> lang2").groupBy("lang1").pivot("lang2").agg(F.round(F.first("sim"), digits)).orderBy("lang1")


def confusable(sims: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs at or over the threshold, which holds before rounding."""
    return sims.where((F.col("lang1") < F.col("lang2")) & (F.col("sim") >= threshold)).select("lang1", "lang2", F.round("sim", 4).alias("sim"))
