"""Learned models, the vote over them, whole jobs, the command line, streams and sources, on small made corpora."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptora import __main__ as cli
from scriptora.operators import ensemble, evaluation, models, profiles, scripts
from scriptora.plans import catalogue, service
from scriptora.sources import corpus_io
from scriptora.streaming import streams

WORDS = {
    "eng": "the book is on table and children are reading while their mother looks for another old story",
    "hin": "यह किताब मेज़ पर रखी है और बच्चे पढ़ रहे हैं लेकिन उनकी माँ दूसरी पुरानी कहानी ढूँढ रही",
    "tam": "புத்தகம் மேசையின் மீது உள்ளது குழந்தைகள் படிக்கிறார்கள் அவர்கள் தாய் வேறு பழைய கதை தேடுகிறார்",
}


def rows(each=40):
    dice, out = random.Random(5), []
    for lang, line in WORDS.items():
        for _ in range(each):
            out.append((f"d{len(out)}", lang, " ".join(dice.choices(line.split(), k=24))))
    return out


@pytest.fixture(scope="module")
def made(spark):
    return spark.createDataFrame(rows(), "doc_id string, lang string, text string").repartition(2).cache()


@pytest.fixture(scope="module")
def ngram(made):
    return models.CharNgramModel(features=400, iterations=8, folds=2).fit(made)


def share_right(df):
    return df.select(F.avg((F.col("lang") == F.col("predicted_lang")).cast("double"))).first()[0]


def wb(text, lo=2, hi=4):
    out = []
    for w in text.lower().split():
        w = f" {w} "
        for n in range(lo, hi + 1):
            out += [w[k : k + n] for k in range(len(w) - n + 1)] or ([w] if len(w) == n - 1 else [])
    return sorted(out)


def test_ngrams_equal_plain_python(spark):
    texts = ["", "a", "An old  Book", "बच्चे पढ़", "x\ty"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", models.char_wb_ngrams(F.col("text")).alias("c"), models.word_ngrams(F.col("text")).alias("w"))
    for r in df.collect():
        own = texts[r["k"]].split()
        assert sorted(r["c"]) == wb(texts[r["k"]])
        assert sorted(r["w"]) == sorted(" ".join(own[k : k + n]) for n in (1, 2, 3) for k in range(len(own) - n + 1))


def test_inverse_document_frequencies(made, ngram):
    seen = {}
    texts = [r[2] for r in rows()]
    for t in texts:
        for g in set(wb(t)):
            seen[g] = seen.get(g, 0) + 1
    want = [np.log((1 + len(texts)) / (1 + seen[g])) + 1 for g in ngram.vocabulary.vocabulary]
    assert np.allclose(ngram.idf, want)


def test_weights_equal_plain_python(spark, ngram):
    texts = ["", None, "zzz", "the book", "the book the book the children", WORDS["tam"] * 3]
    place = {g: k for k, g in enumerate(ngram.vocabulary.vocabulary)}
    found = ngram._vectors(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text").collect()
    assert sorted(r["k"] for r in found) == list(range(len(texts)))
    for r in found:
        grams = [place[g] for g in wb(texts[r["k"]] or "") if g in place]
        want = np.zeros(len(place))
        for k in set(grams):
            want[k] = (1 + np.log(grams.count(k))) * ngram.idf[k]
        want /= np.linalg.norm(want) or 1
        assert list(r["_x"].indices) == sorted(set(grams)) and np.allclose(r["_x"].toArray(), want, rtol=1e-12, atol=0)


def test_char_ngram_query_needs_no_python_worker(spark, sf, monkeypatch):
    """With no Python to start, its training and scoring would fail if either ran a worker."""
    monkeypatch.setattr(spark.sparkContext, "pythonExec", "/nowhere/python")
    found = catalogue.QUERIES["ngram_model_lang"](spark, sf).collect()
    assert len(found) == 12 and all(r["id"] == r["predicted_lang"] for r in found)


def test_char_ngram_model(spark, made, ngram, tmp_path):
    assert share_right(ngram.predict(made)) > 0.95
    held = spark.createDataFrame([("eng", "children look for the old book"), ("tam", "பழைய புத்தகம்"), ("eng", None), ("eng", "")], "lang string, text string")
    found = ngram.predict(held).collect()
    assert [r["predicted_lang"] for r in found[:2]] == ["eng", "tam"]
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in found)
    ngram.save(str(tmp_path / "m"))
    again = models.CharNgramModel.load(spark, str(tmp_path / "m")).predict(held).collect()
    assert [r["probs"] for r in again] == [r["probs"] for r in found]
    tops = ngram.top_features(5)
    assert set(tops) == set(WORDS) and all(len(v) == 5 for v in tops.values())


def test_vote_over_models(spark, made, ngram, tmp_path):
    words = models.WordNgramModel(features=1 << 10, iterations=8).fit(made)
    out = ensemble.predict(made, {"ngram": ngram, "fasttext": words})
    assert share_right(out) > 0.95
    one = out.where("lang = 'hin'").first()
    assert set(one["model_contributions"]) == {"ngram", "fasttext", "heuristic"} and len(one["top_5"]) == 5
    both = words.transform(ngram.transform(made, output="p1"), output="p2")
    meta = models.Stacking().fit(both, ["p1", "p2"])
    assert meta.classes == sorted(WORDS) and meta.model.numFeatures == 6
    words.save(str(tmp_path / "words"))
    meta.save(str(tmp_path / "meta"))
    models.save_vote(spark, {"fasttext": 1.0}, {"fasttext": str(tmp_path / "words")}, str(tmp_path / "vote"))
    weights, places = models.load_vote(spark, str(tmp_path / "vote"))
    again = models.WordNgramModel.load(spark, places["fasttext"])
    assert weights == {"fasttext": 1.0} and [r["p2"] for r in again.transform(made, output="p2").collect()] == [r["p2"] for r in words.transform(made, output="p2").collect()]
    told = models.Stacking.load(spark, str(tmp_path / "meta")).transform(both, ["p1", "p2"])
    best = told.withColumn("predicted_lang", F.get(F.array(*map(F.lit, meta.classes)), F.array_position("probs", F.array_max("probs")).cast("int") - 1))
    assert share_right(best) > 0.95


def test_any_batch_function_is_a_scorer(spark, made):
    def make():
        def of(texts):
            return np.array([[0.9, 0.1] if str(t).isascii() else [0.2, 0.8] for t in texts])

        return of

    found = models.BatchScorer(make, ["eng", "hin"]).transform(made, output="p").select("lang", "p").collect()
    assert all((r["p"][0] > 0.5) == (r["lang"] == "eng") for r in found)


def test_identify(spark):
    df = spark.createDataFrame([(1, "The book is on the table and it is old."), (2, "abc"), (3, None), (4, "x" * 10_001), (5, WORDS["tam"])], "id int, text string")
    out = {r["id"]: r for r in service.identify(df, with_scripts=True, with_alternatives=True).collect()}
    assert [out[k]["accepted"] for k in range(1, 6)] == [True, False, False, False, True]
    assert (out[1]["predicted_lang"], out[1]["direction"], out[5]["predicted_lang"], out[2]["predicted_lang"]) == ("eng", "LTR", "tam", None)
    assert out[5]["script_analysis"]["dominant_script"] == "Tamil" and out[5]["script"] == "Tamil"
    assert sum(r["n"] for r in service.batch_summary(service.identify(df)).collect()) == 2
    report = service.script_report(df).collect()
    assert max(r["total_chars"] for r in report) == 10_000 and len(report) == 5


def test_service_bounds_counters_and_views(spark):
    own = service.Service(spark)
    found = own.answer(["The book is on the table.", "abc", WORDS["tam"]]).collect()
    assert [r["accepted"] for r in found] == [True, False, True]
    for texts in ([], ["x"] * 101):
        with pytest.raises(ValueError):
            own.answer(texts)
    status = own.status()
    assert (status["requests"], status["characters"], status["languages"], status["models"]) == (1, 25 + 3 + len(WORDS["tam"]), 12, [])
    view = {r["predicted_lang"]: r["share"] for r in service.batch_view(service.identify_batch(spark, ["The book is on the table.", WORDS["tam"]])).collect()}
    assert view == {"eng": 0.5, "tam": 0.5}
    assert service.language_view(spark).count() == 12


def test_cached_and_remembered_loads_and_unions(spark, made, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return made.limit(n)

    assert [corpus_io.cached(spark, str(tmp_path / "c"), lambda n=n: build(n), rows=n).count() for n in (3, 5, 3)] == [3, 5, 3] and built == [3, 5]
    memo = corpus_io.Memo()
    assert memo.get(lambda: build(2), rows=2) is memo.get(lambda: build(2), rows=2) and built == [3, 5, 2]
    memo.clear()
    for lang in WORDS:
        made.where(F.col("lang") == lang).drop("lang").write.parquet(str(tmp_path / lang))
    both = corpus_io.load_language_files(spark, {lang: str(tmp_path / lang) for lang in WORDS})
    assert {r["lang"]: r["count"] for r in both.groupBy("lang").count().collect()} == dict.fromkeys(WORDS, 40)
    with pytest.raises(ValueError):
        corpus_io.load_language_files(spark, {})


def test_streams_of_languages_are_mixed(spark, made, tmp_path):
    for lang in WORDS:
        made.where(F.col("lang") == lang).drop("lang").coalesce(1).write.parquet(str(tmp_path / lang))
    seen = []
    each = {lang: streams.read_corpus(spark, str(tmp_path / lang), "doc_id string, text string") for lang in WORDS}
    streams.stream_batches(streams.interleaved(each), lambda df, epoch: seen.extend((r["batch"], r["lang"], r["doc_id"]) for r in df.repartition(1).sortWithinPartitions("batch").collect()), str(tmp_path / "state"), batch_size=16, seed=3).awaitTermination()
    want = {d for d, _, t in rows() if len(t) >= 50 and sum(c.isalpha() for c in t) / len(t) >= 0.4}
    assert sorted(d for *_, d in seen) == sorted(want) and {lang for _, lang, _ in seen} <= set(WORDS)


def test_script_reports_of_part_of_a_text_say_so(spark):
    df = spark.createDataFrame([(1, "x" * 10_000), (2, "x" * 10_001), (3, None)], "id int, text string")
    assert {r["id"]: r["accepted"] for r in service.script_report(df).collect()} == {1: True, 2: False, 3: False}


def test_training_job(spark, made, tmp_path):
    made.write.parquet(str(tmp_path / "corpus"))
    done = service.train(spark, str(tmp_path / "corpus"), str(tmp_path / "out"), languages=["eng", "tam"], iterations=5, features=200)
    report = {r["model"]: r for r in done.report.collect()}
    assert set(report) == {"ngram", "fasttext", "ensemble"} and report["ensemble"]["accuracy"] > 0.9 and all(r["seconds"] > 0 for r in report.values())
    parts = [corpus_io.read_split(spark, str(tmp_path / "out/splits"), k).count() for k in ("train", "val", "test")]
    assert sum(parts) == 80 and all(parts)
    assert set(done.ngram.thresholds) == {"eng", "tam"}
    for name in ("profiles", "richness", "confusable", "metrics"):
        assert (tmp_path / "out" / name).exists()
    judged = evaluation.confusion(made.select(F.col("lang").alias("true"), F.col("lang").alias("pred"), F.lit(0.9).alias("confidence")))
    page = service.html_report(evaluation.overall(judged), evaluation.class_report(judged))
    assert page.startswith("<!DOCTYPE html>") and all(f"<td>{k}</td>" in page for k in WORDS)


def test_no_rows_of_a_language_is_an_error(spark, made, tmp_path):
    made.write.parquet(str(tmp_path / "corpus"))
    with pytest.raises(ValueError):
        corpus_io.load_languages(spark, str(tmp_path / "corpus"), ["urd"])
    some = corpus_io.load_alignable(spark, str(tmp_path / "corpus"), 7)
    assert some.count() == 7 and some.columns == ["text", "lang", "label", "doc_id"]


def test_command_line(spark, capsys, tmp_path):
    cli.main(["The book is on the table.", WORDS["hin"]])
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert sorted(r["predicted_lang"] for r in out) == ["eng", "hin"] and all("script_analysis" in r for r in out)
    (tmp_path / "a.txt").write_text(WORDS["tam"])
    cli.main(["--file", str(tmp_path), "--no-script"])
    (only,) = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert only["predicted_lang"] == "tam" and "script_analysis" not in only


def test_lines_of_texts(spark, made, tmp_path):
    raw = spark.createDataFrame([(" a \n\n b\n" + "c\n" * 60,), (None,)], "value string")
    assert [(r["line_no"], r["text"]) for r in corpus_io.read_lines(raw).collect()[:3]] == [(0, "a"), (1, "b"), (2, "c")]
    assert corpus_io.read_lines(raw).count() == 50
    corpus_io.write_fasttext(made, str(tmp_path / "ft"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "ft")).collect()) == sorted(f"__label__{lang} {text}" for _, lang, text in rows())


SCHEMA = "doc_id string, lang string, text string"


def drained(spark, stream, path, mode="complete"):
    def keep(df, epoch):
        df.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def test_stream_batches(spark, made, tmp_path):
    made.write.parquet(str(tmp_path / "in"))
    seen = []

    def handle(df, epoch):
        seen.extend((epoch, r["batch"], r["doc_id"]) for r in df.collect())

    streams.stream_batches(streams.read_corpus(spark, str(tmp_path / "in"), SCHEMA), handle, str(tmp_path / "state"), batch_size=16, seed=3).awaitTermination()
    want = {d for d, _, t in rows() if len(t) >= 50 and sum(c.isalpha() for c in t) / len(t) >= 0.4}
    assert sorted(d for *_, d in seen) == sorted(want)
    sizes = {}
    for epoch, batch, _ in seen:
        sizes[epoch, batch] = sizes.get((epoch, batch), 0) + 1
    assert max(sizes.values()) <= 16 and len({e for e, _ in sizes}) == 2


@pytest.mark.parametrize("kind", ["word", "char", "bigram", "trigram"])
def test_running_counts_equal_the_batch(spark, made, tmp_path, kind):
    made.write.parquet(str(tmp_path / "in"))
    found = drained(spark, streams.token_counts(streams.read_corpus(spark, str(tmp_path / "in"), SCHEMA), kind), tmp_path)
    docs = profiles.documents(made, False)
    raw = profiles.raw_word_counts(docs)
    want = {"word": lambda: profiles.word_counts(raw), "char": lambda: profiles.char_counts(docs), "bigram": lambda: profiles.ngram_counts(raw, 2), "trigram": lambda: profiles.ngram_counts(raw, 3)}[kind]()
    key = lambda df: sorted((r["lang"], r["token"], r["n"]) for r in df.collect())
    assert key(found) == key(want)


def test_running_lengths_and_scores(spark, made, tmp_path):
    made.write.parquet(str(tmp_path / "in"))
    histogram = drained(spark, streams.length_histogram(streams.read_corpus(spark, str(tmp_path / "in"), SCHEMA)), tmp_path / "h")
    assert sum(r["n"] for r in histogram.collect()) == len(rows())
    scored = drained(spark, streams.score(streams.read_corpus(spark, str(tmp_path / "in"), SCHEMA, 100)), tmp_path / "s", "append")
    assert share_right(scored) == 1.0


def test_segments_of_many_runs(spark):
    """Chunks of runs join without a gap: every run is placed as by a plain loop."""
    texts = ["", None, "..", *["abc नमस " * k for k in (1, 31, 32, 33, 64, 100)], "?!" + "abcनमस" * 200 + "é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", scripts.segments(F.col("text")).alias("s"), scripts.segment_count(F.col("text")).alias("n"))
    for r in df.collect():
        text, want = texts[r["k"]] or "", []
        for at, c in enumerate(text):
            if not c.isalpha():
                continue
            block = "Devanagari" if 0x900 <= ord(c) <= 0x97F else "Basic Latin" if c.isascii() else "Latin-1 Supplement"
            if not want or want[-1][0] != block:
                want.append([block, at, len(text), 0])
                if len(want) > 1:
                    want[-2][2] = at
            want[-1][3] += 1
        want = [(b, s, e, text[s:e]) for b, s, e, n in want if n >= 3]
        assert [(x["script"], x["start"], x["end"], x["text"]) for x in r["s"]] == want and r["n"] == len(want)
