"""Weighted soft vote over any scorers, with the rules' short cut, their blend and the Hindi/Marathi markers."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.functions import registry as R
from scriptora.functions.cleaning import preview
from scriptora.operators import heuristic

WEIGHTS = {"ngram": 0.35, "fasttext": 0.50, "transformer": 0.15}
#: Words whose presence tells the two Devanagari languages apart.
MARATHI = ["आहे", "आहेत", "होते", "केले", "त्यांनी", "आणि", "मराठी"]
HINDI = ["है", "हैं", "था", "थे", "में", "और", "से", "हिंदी"]


class Scorer(Protocol):
    """Anything that adds a column of class probabilities in the order of its classes."""

    classes: list[str]

    def transform(self, df: DataFrame, text: str, output: str) -> DataFrame: ...


def aligned(probs: Column, classes: list[str]) -> Column:
    """Probabilities in the registry's order; a class that a model lacks has 0."""
    return F.array(*[F.coalesce(F.get(probs, F.lit(classes.index(c))), F.lit(0.0)) if c in classes else F.lit(0.0) for c in R.CODES])


def soft_vote(probs: Mapping[str, Column], weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Weighted mean over the active models; zeros if there is none."""
    total = sum(weights.get(k, 0.0) for k in probs)
    out = F.array(*[F.lit(0.0)] * len(R.CODES))
    for k, p in probs.items():
        share = weights.get(k, 0.0) / total if total else 0.0
        out = F.zip_with(out, F.transform(p, lambda x: x * share), lambda a, b: a + b)  # noqa: B023
    return out


def blended(vote: Column, lang: Column, conf: Column) -> Column:
    """The rules' language at 0.7 of its vote and 0.3 of their confidence where that is 0.55 or more; not renormalised."""
    codes = F.array(*map(F.lit, R.CODES))
    own = F.zip_with(vote, codes, lambda p, c: F.when(c == lang, 0.7 * p + 0.3 * conf).otherwise(p))
    return F.when(lang.isNotNull() & (conf >= 0.55), own).otherwise(vote)


def first_largest(probs: Column) -> Column:
    return F.get(F.array(*map(F.lit, R.CODES)), F.array_position(probs, F.array_max(probs)).cast("int") - 1)


def top_classes(probs: Column, k: int = 5) -> Column:
    """array<struct<lang,name,probability>> of the k largest; ties by code."""
    names = F.array(*[F.struct(F.lit(r[0]).alias("lang"), F.lit(r[1]).alias("name")) for r in R.LANGUAGES])
    pairs = F.array_sort(F.zip_with(probs, names, lambda p, x: F.struct((-p).alias("p"), x["lang"].alias("lang"), x["name"].alias("name"))))
    return F.transform(F.slice(pairs, 1, k), lambda x: F.struct(x["lang"].alias("lang"), x["name"].alias("name"), (-x["p"]).alias("probability")))


def marker_count(text: Column, markers: list[str]) -> Column:
    out = F.lit(0)
    for m in markers:
        out = out + F.contains(text, F.lit(m)).cast("int")
    return out


def predict(df: DataFrame, scorers: Mapping[str, Scorer] | None = None, weights: Mapping[str, float] = WEIGHTS, text: str = "text") -> DataFrame:
    """df with the prediction record of each text.

    Texts that the rules settle (0.92 or more and not Devanagari) keep their
    answer. Null texts are empty ones; without a model and a rule the first
    language of the registry answers with 0.
    """
    scorers = scorers or {}
    out = heuristic.identify(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), "_t")
    for name, scorer in scorers.items():
        out = scorer.transform(out, "_t", f"_p_{name}").withColumn(f"_p_{name}", aligned(F.col(f"_p_{name}"), scorer.classes))
    lang, conf = F.col("rule_lang"), F.col("rule_confidence")
    out = out.withColumn("_vote", blended(soft_vote({k: F.col(f"_p_{k}") for k in scorers}, weights), lang, conf))
    out = out.withColumns({"_lang": first_largest(F.col("_vote")), "_conf": F.array_max("_vote"), "_mar": marker_count(F.col("_t"), MARATHI), "_hin": marker_count(F.col("_t"), HINDI)})
    deva = F.col("_lang").isin("hin", "mar")
    short = lang.isNotNull() & (conf >= 0.92) & ~lang.isin("hin", "mar")
    mar, hin = deva & (F.col("_mar") > F.col("_hin") + 1), deva & (F.col("_hin") > F.col("_mar") + 1)
    out = out.withColumns({
        "predicted_lang": F.when(short, lang).when(mar, "mar").when(hin, "hin").otherwise(F.col("_lang")),
        "confidence": F.round(F.when(short, conf).when(mar, F.least(F.lit(0.95), F.col("_conf") + 0.1 * F.col("_mar"))).when(hin, F.least(F.lit(0.95), F.col("_conf") + 0.05 * F.col("_hin"))).otherwise(F.col("_conf")), 4),
        "source": F.when(short, "heuristic").otherwise("ensemble"), "top_5": top_classes(F.col("_vote")),
    })
    parts = [F.struct(F.lit(k).alias("key"), F.struct(first_largest(F.col(f"_p_{k}")).alias("lang"), F.round(F.array_max(f"_p_{k}"), 4).alias("confidence")).alias("value")) for k in scorers]
    rule = F.when(lang.isNotNull(), F.array(F.struct(F.lit("heuristic").alias("key"), F.struct(lang.alias("lang"), F.round(conf, 4).alias("confidence")).alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:struct<lang:string,confidence:double>>>"))
    out = out.withColumns({
        "text_preview": preview(F.col("_t"), 80), "predicted_lang_name": R.name_of(F.col("predicted_lang")), "script": R.script_of(F.col("predicted_lang")), "direction": R.direction_of(F.col("predicted_lang")),
        "is_confident": F.col("confidence") >= 0.75, "model_contributions": F.map_from_entries(F.concat(F.array(*parts), rule) if parts else rule),
    })
    return out.drop("_t", "_vote", "_lang", "_conf", "_mar", "_hin", *(f"_p_{k}" for k in scorers))


def batch_stats(predictions: DataFrame) -> DataFrame:
    """Per predicted language: rows, mean confidence and confident rows."""
    return predictions.groupBy("predicted_lang").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"), F.count_if("is_confident").alias("n_confident"))
