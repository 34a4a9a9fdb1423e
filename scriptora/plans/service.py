"""Whole jobs: identification of texts, script reports, and the training pipeline."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.functions import registry as R
from scriptora.functions.cleaning import Cleaning, preprocess
from scriptora.operators import corpus, ensemble, evaluation, heuristic, models, profiles, scripts
from scriptora.sources import corpus_io


def identify(df: DataFrame, scorers: Mapping[str, ensemble.Scorer] | None = None, clean: bool = True, with_scripts: bool = False, with_alternatives: bool = False, text: str = "text") -> DataFrame:
    """df with the answer of an identification request for each text.

    Texts of other than 5 to 10000 characters are not accepted: `accepted` is
    false and the answer null. Without scorers the rules answer, English at
    0.5 where they don't say. with_scripts adds the analysis of the raw text.
    """
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    staged = df.withColumn("accepted", size.between(5, 10_000)).withColumn("_clean", preprocess(F.col(text), Cleaning()) if clean else F.coalesce(F.col(text), F.lit("")))
    if scorers:
        out = ensemble.predict(staged, scorers, text="_clean")
    else:
        out = heuristic.with_fallback(heuristic.identify(staged, "_clean"))
        out = out.withColumns({"predicted_lang": F.col("rule_lang"), "confidence": F.round("rule_confidence", 4), "is_confident": F.col("rule_confidence") >= 0.75, "source": F.lit("heuristic"), "top_5": F.lit(None).cast("array<struct<lang:string,name:string,probability:double>>")})
    answer = ["predicted_lang", "confidence", "is_confident", "source"] + ["top_5"] * with_alternatives
    out = out.withColumns({c: F.when(F.col("accepted"), F.col(c)) for c in answer})
    out = out.withColumns({"name": R.name_of(F.col("predicted_lang")), "script": F.when(F.col("accepted"), R.script_of(F.col("predicted_lang"))), "direction": F.when(F.col("accepted"), R.direction_of(F.col("predicted_lang"))), "text_length": size})
    out = out.select(*df.columns, "accepted", *answer, "name", "script", "direction", "text_length")
    if not with_scripts:
        return out
    analyzed = scripts.analyze(out.withColumnsRenamed({"script": "_script"}), text)
    return analyzed.withColumnRenamed("_script", "script").select(*out.columns, F.struct(*scripts.PUBLIC).alias("script_analysis"))


def identify_batch(spark: SparkSession, texts: list[str], scorers: Mapping[str, ensemble.Scorer] | None = None, clean: bool = True) -> DataFrame:
    """identify for a request of 1 to 100 texts, in their order (`place`); any other number is refused."""
    if not 1 <= len(texts) <= 100:
        raise ValueError("a batch has 1 to 100 texts")
    df = spark.createDataFrame(list(enumerate(texts)), "place int, text string")
    return identify(df, scorers, clean).orderBy("place")


class Service:
    """Identification with the counters and the status of a running service."""

    def __init__(self, spark: SparkSession, scorers: Mapping[str, ensemble.Scorer] | None = None):
        self.spark, self.scorers, self.began = spark, dict(scorers or {}), time.time()
        self.requests, self.chars = 0, 0

    def answer(self, texts: list[str]) -> DataFrame:
        out = identify_batch(self.spark, texts, self.scorers)
        self.requests += 1
        self.chars += sum(map(len, texts))
        return out

    def status(self) -> dict:
        return {"status": "ready", "models": sorted(self.scorers), "languages": len(R.CODES), "requests": self.requests, "characters": self.chars, "seconds": time.time() - self.began}


def language_view(spark: SparkSession) -> DataFrame:
    """What a language explorer shows of each registered language."""
    return R.registry(spark).select("code", "name", "native_name", "script", "family", "direction", F.concat_ws(",", "shares_script_with").alias("shares_script_with"))


def batch_view(identified: DataFrame) -> DataFrame:
    """What a batch page shows: a row a predicted language with its share of the accepted texts."""
    by = batch_summary(identified)
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("every")))).select(*by.columns, (F.col("n") / F.col("every")).alias("share"))  # one row is added


def batch_summary(identified: DataFrame) -> DataFrame:
    return ensemble.batch_stats(identified.where("accepted"))


def script_report(df: DataFrame, text: str = "text") -> DataFrame:
    """The public fields of the analysis, from at most 10000 characters a text; `accepted` is false where that is not the whole text, or there is none."""
    marked = df.withColumns({"accepted": F.length(F.coalesce(F.col(text), F.lit(""))).between(1, 10_000), text: F.substring(text, 1, 10_000)})
    return scripts.analyze(marked, text).select(*df.columns, "accepted", *scripts.PUBLIC)


@dataclass
class Trained:
    ngram: models.CharNgramModel
    fasttext: models.WordNgramModel | None
    report: DataFrame


def train(spark: SparkSession, corpus_path: str, out: str, languages: list[str] | None = None, max_per_lang: int | None = None, iterations: int = 100, features: int = 150_000, word_model: bool = True) -> Trained:
    """Load, clean, split, profile, train, vote, evaluate; everything that a stage gives is under `out`."""
    df = corpus_io.cleaned(corpus_io.load_languages(spark, corpus_path, languages, max_per_lang, shuffle=False))
    corpus_io.write_splits(corpus.split(df), f"{out}/splits")
    part = {k: corpus_io.read_split(spark, f"{out}/splits", k) for k in ("train", "val", "test")}
    docs = profiles.documents(part["train"])
    raw = profiles.raw_word_counts(docs)
    corpus_io.write_json(profiles.stats(docs), f"{out}/profiles")
    corpus_io.write_json(profiles.richness(profiles.word_counts(raw)), f"{out}/richness")
    corpus_io.write_json(profiles.confusable(profiles.similarity(profiles.ngram_counts(raw, 2)), 0.7), f"{out}/confusable")
    ngram = models.CharNgramModel(features, iterations=iterations).fit(part["train"])
    held = ngram.transform(part["val"], output="probs")
    long = held.select(F.col("lang").alias("true"), F.posexplode("probs").alias("k", "p")).withColumn("lang", F.get(F.array(*map(F.lit, ngram.classes)), "k"))
    ngram.thresholds = {r["lang"]: r["threshold"] for r in evaluation.confidence_thresholds(long).collect()}
    ngram.save(f"{out}/ngram")
    words = models.WordNgramModel(iterations=iterations).fit(part["train"]) if word_model else None
    scorers = {"ngram": ngram} | ({"fasttext": words} if words else {})
    if words:
        words.save(f"{out}/fasttext")
    models.save_vote(spark, {k: ensemble.WEIGHTS[k] for k in scorers}, {k: f"{out}/{k}" for k in scorers}, f"{out}/vote")
    report, found = None, {}
    for name in [*scorers, "ensemble"]:
        began = time.time()
        if name == "ensemble":
            told = ensemble.predict(part["test"], scorers).select("doc_id", F.col("lang").alias("true"), F.col("predicted_lang").alias("pred"), "confidence")
        else:
            own = scorers[name].transform(part["test"], output="probs")
            told = own.select("doc_id", F.col("lang").alias("true"), F.get(F.array(*map(F.lit, scorers[name].classes)), F.array_position("probs", F.array_max("probs")).cast("int") - 1).alias("pred"))
        told = told.select("true", "pred").persist()
        told.count()
        row = evaluation.overall(evaluation.confusion(told)).withColumn("model", F.lit(name)).withColumn("seconds", F.lit(time.time() - began))
        report = row if report is None else report.unionByName(row)
        found[name] = told
    corpus_io.write_json(report, f"{out}/metrics")
    for told in found.values():
        told.unpersist()
    return Trained(ngram, words, spark.read.json(f"{out}/metrics"))


def html_report(overall: DataFrame, report: DataFrame) -> str:
    """Metrics as a small page; both tables have a row a class at most."""
    one = overall.first().asDict()
    rows = "".join(f"<tr><td>{r['class']}</td><td>{r['precision']:.4f}</td><td>{r['recall']:.4f}</td><td>{r['f1']:.4f}</td><td>{r['support']}</td><td>{r['band']}</td></tr>" for r in evaluation.f1_bands(report).collect())
    head = "".join(f"<li>{k}: {v}</li>" for k, v in one.items())
    return f"<!DOCTYPE html><meta charset=utf-8><title>Evaluation</title><ul>{head}</ul><table><tr><th>class<th>precision<th>recall<th>F1<th>support<th>band</tr>{rows}</table>"
