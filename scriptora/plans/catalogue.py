"""Every query by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.functions import characters as C
from scriptora.functions import cleaning
from scriptora.functions import registry as R
from scriptora.operators import corpus, ensemble, evaluation, heuristic, models, profiles, scripts
from scriptora.plans import fixture, service
from scriptora.plans.oracle import ORACLE_SQL
from scriptora.sources import corpus_io
from scriptora.sources.shared import work_path

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang (registered code where there is one), text."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", R.corpus_code(F.col("lang")).alias("lang"), "text"))


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a table of few splits over all cores; one with splits enough is left as it is, unshuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < 2 * cores else df


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def as_text(column: str) -> F.Column:
    """A map of shares as one string in millionths, sorted by name, so that engines compare alike."""
    entries = F.array_sort(F.map_entries(column))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.floor(e["value"] * 1e6 + 1e-3).cast("string"))), ";")


# Cleaning

WITHOUT_NFC = cleaning.Cleaning(unicode_form=None)


@query
def clean_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", cleaning.preprocess(F.col("text"), WITHOUT_NFC).alias("clean"))


@query
def strip_html(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", cleaning.preprocess(F.col("html"), WITHOUT_NFC).alias("clean"))


@query
def nfc_clean(spark, sf_dir):
    return fixture.frame(spark).select("id", cleaning.preprocess(F.col("text")).alias("clean"))


@query
def lower_latin(spark, sf_dir):
    return fixture.frame(spark).select("id", cleaning.lower_latin(F.col("text")).alias("lowered"), cleaning.preview(F.col("text"), 10).alias("preview"))


@query
def fasttext_lines(spark, sf_dir):
    return corpus_io.fasttext_lines(docs(spark, sf_dir))


# Filters and corpus preparation


@query
def quality_gate(spark, sf_dir):
    return corpus.quality_gate(docs(spark, sf_dir)).select("doc_id", "lang", "text", F.col("text_len").cast("long").alias("text_len"))


@query
def post_clean_filter(spark, sf_dir):
    cleaned = docs(spark, sf_dir).select("doc_id", C.once(cleaning.preprocess(F.col("text"), WITHOUT_NFC)).alias("text"))
    return cleaned.where(F.length("text") >= 30).select("doc_id", F.length("text").cast("long").alias("clean_len"))


@query
def dataset_stats(spark, sf_dir):
    return corpus.dataset_stats(corpus.quality_gate(docs(spark, sf_dir))).withColumn("avg_len", F.round("avg_len", 6))


@query
def balanced_sample(spark, sf_dir):
    return corpus.balanced(docs(spark, sf_dir)).select("doc_id", "lang")


@query
def stratified_split(spark, sf_dir):
    return corpus.split(docs(spark, sf_dir)).select("doc_id", "lang", "split")


@query
def seeded_order(spark, sf_dir):
    return corpus.shuffled(docs(spark, sf_dir)).select("doc_id", corpus.seeded(42).alias("place"))


@query
def registry_rows(spark, sf_dir):
    return R.registry(spark).select("code", "name", "script", "iso639_1", "label_id", "direction", "family", F.size("unicode_ranges").cast("long").alias("n_ranges"), F.array_join("shares_script_with", ",").alias("shares"))


# Characters and scripts


@query
def char_class_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *(c.alias(name) for name, c in C.class_counts(F.col("text")).items()))


@query
def char_entropy(spark, sf_dir):
    staged = docs(spark, sf_dir).select("doc_id", C.tally(F.col("text")).alias("chars"))
    return staged.select("doc_id", F.round(C.entropy(F.col("chars")), 6).alias("char_entropy"), F.size("chars").cast("long").alias("unique_chars"))


@query
def text_features(spark, sf_dir):
    out = C.with_text_features(docs(spark, sf_dir)).withColumn("script_distribution", as_text("script_distribution"))
    names = ["alpha_ratio", "digit_ratio", "unique_char_ratio", "quality_score", "avg_word_len", "char_entropy"]
    return out.select("doc_id", "n_chars", "n_alpha", "n_digits", "n_punct", "n_spaces", "dominant_script", "script_distribution", "script_count", "is_mixed_script", "n_words", *r6(*names))


@query
def dominant_script(spark, sf_dir):
    out = C.with_text_features(fixture.frame(spark))
    return out.select("id", "dominant_script", as_text("script_distribution").alias("script_distribution"), "n_alpha", "n_digits", "n_punct", *r6("quality_score", "char_entropy"))


@query
def unicode_blocks(spark, sf_dir):
    out = scripts.analyze(docs(spark, sf_dir))
    return out.select("doc_id", as_text("unicode_blocks").alias("unicode_blocks"))


SCRIPT_FIELDS = [
    "total_chars", "alpha_chars", "digit_chars", "punct_chars", "space_chars", "other_chars", "dominant_script", "is_mixed_script", "script_transitions", "primary_direction", "has_bidi", "has_zero_width", "has_control_chars",
    "has_excessive_punct", "url_count", "emoji_count",
]
SCRIPT_DOUBLES = ["dominant_script_ratio", "mixing_score", "rtl_ratio", "latin_ratio", "noise_score", "char_entropy"]


@query
def script_analysis(spark, sf_dir):
    out = scripts.analyze(docs(spark, sf_dir))
    return out.select("doc_id", *SCRIPT_FIELDS, as_text("script_distribution").alias("script_distribution"), *r6(*SCRIPT_DOUBLES))


@query
def script_analysis_indic(spark, sf_dir):
    out = scripts.analyze(fixture.frame(spark))
    return out.select("id", *SCRIPT_FIELDS, as_text("script_distribution").alias("script_distribution"), *r6(*SCRIPT_DOUBLES))


@query
def script_segments(spark, sf_dir):
    every = docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "text").unionByName(fixture.frame(spark))
    out = every.select("id", F.posexplode(scripts.segments(F.col("text"))).alias("pos", "s"))
    return out.select("id", F.col("pos").cast("long").alias("pos"), "s.script", F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"), F.col("s.text").alias("segment"))


@query
def transliteration(spark, sf_dir):
    out = scripts.transliteration(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return out.select("conv_id", "turn", "is_transliteration", "confidence", "latin_dominated", "has_indic_patterns", "has_aspirates", "has_retroflex", "has_nasal_markers")


@query
def compare_scripts(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    out = scripts.compare(turns.join(following, ["conv_id", "turn"]), "text", "next_text")
    return out.select("conv_id", "turn", F.array_join("shared_scripts", ",").alias("shared_scripts"), *r6("script_jaccard", "text1_mixing_score", "text2_mixing_score"), "text1_dominant", "text2_dominant")


@query
def lang_hints(spark, sf_dir):
    out = scripts.analyze(fixture.frame(spark)).withColumn("e", F.array_sort(F.map_entries("lang_hints")))
    return out.select("id", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], ","))), ";").alias("hints"))


def _chars(spark):
    return spark.createDataFrame([(c,) for c, _ in fixture.CHARACTERS], "c string")


@query
def char_script_names(spark, sf_dir):
    return _chars(spark).select("c", C.char_script_name(F.col("c")).alias("script"))


@query
def char_in_script(spark, sf_dir):
    codes = F.explode(F.array(*map(F.lit, R.CODES)))
    return _chars(spark).withColumn("code", codes).select("c", "code", R.char_in_script(F.col("c"), F.col("code")).alias("inside"))


# Rule-based identification


@query
def heuristic_lang(spark, sf_dir):
    return heuristic.identify(docs(spark, sf_dir)).select("doc_id", "rule_lang", F.round("rule_confidence", 6).alias("rule_confidence"))


@query
def heuristic_indic(spark, sf_dir):
    return heuristic.identify(fixture.frame(spark)).select("id", "rule_lang", F.round("rule_confidence", 6).alias("rule_confidence"))


@query
def heuristic_fallback(spark, sf_dir):
    out = heuristic.with_fallback(heuristic.identify(fixture.frame(spark)))
    return out.select("id", "rule_lang", F.round("rule_confidence", 6).alias("rule_confidence"))


@query
def language_by_label(spark, sf_dir):
    """Flagship: cleaned documents, identified by the rules, counted by label and answer."""
    cleaned = docs(spark, sf_dir).select("lang", C.once(cleaning.preprocess(F.col("text"), WITHOUT_NFC)).alias("text")).where(F.length("text") >= 30)
    found = heuristic.identify(cleaned).groupBy("lang", "rule_lang").agg(F.count("*").alias("n"), F.round(F.avg("rule_confidence"), 6).alias("mean_confidence"))
    return found.select("lang", R.name_of(F.col("lang")).alias("name"), "rule_lang", "n", "mean_confidence").orderBy("lang", "rule_lang")


# Profiles


def _profile(spark, sf_dir, registry_only=False):
    return profiles.documents(docs(spark, sf_dir), registry_only)


@query
def char_freq_top(spark, sf_dir):
    return profiles.top(profiles.char_counts(_profile(spark, sf_dir)), 20).select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def word_freq_top(spark, sf_dir):
    return profiles.top(profiles.word_counts(profiles.raw_word_counts(_profile(spark, sf_dir))), 30).select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def bigram_top(spark, sf_dir):
    return profiles.top(profiles.ngram_counts(profiles.raw_word_counts(_profile(spark, sf_dir)), 2), 20).select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def trigram_top(spark, sf_dir):
    return profiles.top(profiles.ngram_counts(profiles.raw_word_counts(_profile(spark, sf_dir)), 3), 20).select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@query
def profile_stats(spark, sf_dir):
    return profiles.stats(_profile(spark, sf_dir), with_tops=False)


@query
def profile_registry_only(spark, sf_dir):
    return profiles.stats(_profile(spark, sf_dir, True), with_tops=False)


@query
def vocab_richness(spark, sf_dir):
    return profiles.richness(profiles.word_counts(profiles.raw_word_counts(_profile(spark, sf_dir)))).select("lang", "name", "V_vocab", "N_tokens", *r6("ttr", "guiraud", "herdan", "yule_k"))


@query
def lang_similarity(spark, sf_dir):
    return profiles.similarity(profiles.ngram_counts(profiles.raw_word_counts(_profile(spark, sf_dir)), 2)).select("lang1", "lang2", F.round("sim", 6).alias("sim"))


@query
def confusable_pairs(spark, sf_dir):
    return profiles.confusable(profiles.similarity(profiles.ngram_counts(profiles.raw_word_counts(_profile(spark, sf_dir)), 2)), 0.2)


@query
def similarity_matrix(spark, sf_dir):
    return profiles.similarity_matrix(profiles.similarity(profiles.ngram_counts(profiles.raw_word_counts(_profile(spark, sf_dir)), 2)))


# Evaluation, with the rules as the predictions


def _judged(spark, sf_dir):
    found = heuristic.identify(docs(spark, sf_dir))
    return found.select("doc_id", "text", F.col("lang").alias("true"), F.coalesce("rule_lang", F.lit("")).alias("pred"), F.col("rule_confidence").alias("confidence")).withColumn("correct", F.col("true") == F.col("pred"))


@query
def confusion(spark, sf_dir):
    return evaluation.normalised(evaluation.confusion(_judged(spark, sf_dir))).withColumn("share", F.round("share", 6))


@query
def class_report(spark, sf_dir):
    return evaluation.class_report(evaluation.confusion(_judged(spark, sf_dir))).select("class", *r6("precision", "recall", "f1"), "support")


@query
def overall_metrics(spark, sf_dir):
    return evaluation.overall(evaluation.confusion(_judged(spark, sf_dir)))


@query
def calibration_error(spark, sf_dir):
    return evaluation.calibration_error(_judged(spark, sf_dir))


@query
def reliability_bins(spark, sf_dir):
    return evaluation.reliability(_judged(spark, sf_dir)).select(F.col("bin").cast("long").alias("bin"), "n", *r6("confidence", "accuracy"))


@query
def full_report(spark, sf_dir):
    return evaluation.full_report(evaluation.confusion(_judged(spark, sf_dir))).select("class", *r6("precision", "recall", "f1"), "support")


@query
def f1_bands(spark, sf_dir):
    return evaluation.f1_bands(evaluation.class_report(evaluation.confusion(_judged(spark, sf_dir)))).select("class", "band")


@query
def confidence_histogram(spark, sf_dir):
    return evaluation.confidence_histogram(_judged(spark, sf_dir)).withColumn("bin", F.col("bin").cast("long"))


@query
def error_summary(spark, sf_dir):
    return evaluation.error_summary(evaluation.confusion(_judged(spark, sf_dir)))


@query
def error_rate(spark, sf_dir):
    return evaluation.error_rate(evaluation.confusion(_judged(spark, sf_dir))).withColumn("error_rate", F.round("error_rate", 6))


@query
def error_samples(spark, sf_dir):
    return evaluation.error_samples(_judged(spark, sf_dir)).select("true_lang", "pred_lang", "doc_id", "text", F.col("rank").cast("long").alias("rank"))


@query
def confidence_thresholds(spark, sf_dir):
    probs = _judged(spark, sf_dir).where("pred <> ''").select("true", F.col("pred").alias("lang"), F.col("confidence").alias("p"))
    return evaluation.confidence_thresholds(probs, 0.6).select("lang", F.round("threshold", 6).alias("threshold"))


# Ensemble


@query
def ensemble_vote(spark, sf_dir):
    out = ensemble.predict(docs(spark, sf_dir))
    return out.select("doc_id", "predicted_lang", "predicted_lang_name", "script", "direction", "confidence", "is_confident", "source", "text_preview")


@query
def devanagari_disambiguation(spark, sf_dir):
    out = ensemble.predict(fixture.frame(spark))
    return out.select("id", "predicted_lang", "confidence", "direction", "source")


@query
def vote_top_five(spark, sf_dir):
    best = F.transform("top_5", lambda x: F.concat(x["lang"], F.lit("="), F.floor(x["probability"] * 1e6 + 1e-3).cast("string")))
    return ensemble.predict(docs(spark, sf_dir)).select("doc_id", F.array_join(best, ";").alias("top_5"))


@query
def aligned_probabilities(spark, sf_dir):
    df = spark.createDataFrame([(1, [0.5, 0.25, 0.25]), (2, [0.0, 0.0, 1.0])], "id long, p array<double>")
    out = ensemble.aligned(F.col("p"), ["hin", "xx", "eng"])
    return df.select("id", F.array_join(F.transform(out, lambda x: F.round(x * 100).cast("int").cast("string")), ",").alias("hundredths"))


@query
def identified_texts(spark, sf_dir):
    """What a service answers, over the bounds of a request too."""
    out = service.identify(docs(spark, sf_dir), clean=False)
    return out.select("doc_id", "accepted", "predicted_lang", "confidence", F.coalesce("is_confident", F.lit(False)).alias("is_confident"), "script", "direction", F.col("text_length").cast("long").alias("text_length"))


# Learned models, trained on the inline sentences of the twelve languages


def _sentences(spark):
    """Each sentence whole and in two parts, so that every n-gram is in two texts."""
    own = fixture.frame(spark).where(F.col("id").isin(R.CODES))
    words = F.split("text", " ")
    half = F.ceil(F.size(words) / 2).cast("int")
    return own.select(F.col("id").alias("lang"), F.explode(F.array(F.col("text"), F.array_join(F.slice(words, F.lit(1), half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))).alias("text")).where("text <> ''")


def _held(spark):
    return fixture.frame(spark).where(F.col("id").isin(R.CODES))


def _char_model(spark):
    return models.CharNgramModel(features=20_000, iterations=40, calibrate=False).fit(_sentences(spark))


def _best(df, classes, probs):
    return df.select("id", F.get(F.array(*map(F.lit, classes)), F.array_position(probs, F.array_max(probs)).cast("int") - 1).alias("predicted_lang"))


@query
def ngram_model_lang(spark, sf_dir):
    return _char_model(spark).predict(_held(spark)).select("id", "predicted_lang")


@query
def word_model_lang(spark, sf_dir):
    model = models.WordNgramModel(features=1 << 12, iterations=40).fit(_sentences(spark))
    return _best(model.transform(_held(spark)), model.classes, "probs")


@query
def model_vote(spark, sf_dir):
    """The vote of both models and the rules, with what each of them said."""
    rows = _sentences(spark)
    scorers = {"ngram": models.CharNgramModel(features=20_000, iterations=40, calibrate=False).fit(rows), "fasttext": models.WordNgramModel(features=1 << 12, iterations=40).fit(rows)}
    told = F.col("model_contributions")
    return ensemble.predict(_held(spark), scorers).select("id", "predicted_lang", told["ngram"]["lang"].alias("ngram"), told["fasttext"]["lang"].alias("words"), F.get("top_5", F.lit(0))["lang"].alias("first_of_five"))


@query
def stacked_models(spark, sf_dir):
    model = _char_model(spark)
    both = ["a", "b"]
    scored = lambda df: model.transform(model.transform(df, output="a"), output="b")
    stack = models.Stacking().fit(scored(_sentences(spark)), both)
    return _best(stack.transform(scored(_held(spark)), both), stack.classes, "probs")


@query
def model_comparison(spark, sf_dir):
    rows = _sentences(spark)
    char, word = models.CharNgramModel(features=20_000, iterations=40, calibrate=False).fit(rows), models.WordNgramModel(features=1 << 12, iterations=40).fit(rows)
    found = {name: _best(m.transform(_held(spark)), m.classes, "probs").select(F.col("id").alias("true"), F.col("predicted_lang").alias("pred")) for name, m in (("ngram", char), ("words", word))}
    return evaluation.compare_models(found)


@query
def batch_stats(spark, sf_dir):
    return ensemble.batch_stats(ensemble.predict(docs(spark, sf_dir)))


@query
def quality_vs_label(spark, sf_dir):
    scored = C.with_text_features(docs(spark, sf_dir)).select("doc_id", "quality_score")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored.join(labels, "doc_id").groupBy(F.col("quality").cast("long").alias("quality")).agg(F.count("*").alias("n"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


# Streams


@query
def stream_profile(spark, sf_dir):
    """Word counts of a stream over the documents, run to its end."""
    from scriptora.streaming import streams

    out = work_path(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/documents.parquet*").select("lang", "text")

    def keep(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/counts")

    run = streams.token_counts(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{out}/counts")
