"""Learned language models on spark.ml: character n-grams and hashed word n-grams, with calibration, thresholds and top features."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptora.functions import characters as C
from scriptora.functions.cleaning import one_line


def char_wb_ngrams(text: Column, lo: int = 2, hi: int = 4) -> Column:
    """Character n-grams of each lower-cased word with a blank at both ends; a padded word shorter than n is a gram itself, once."""
    padded = F.transform(C.words(F.lower(text)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda n: lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (n - 1))), lambda k: F.substring(w, k, F.lit(n)))).otherwise(F.when(F.length(w) == n - 1, F.array(w)).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.concat(*[F.transform(padded, grams(n)) for n in range(lo, hi + 1)]))


def word_ngrams(text: Column, most: int = 3) -> Column:
    words = C.words(text)
    grams = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - (n - 1))), lambda k: F.array_join(F.slice(words, k, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[grams(n) for n in range(1, most + 1)])


class CharNgramModel:
    """TF-IDF of character n-grams and multinomial regression, optionally calibrated by isotonic regression over folds."""

    def __init__(self, features: int = 150_000, c: float = 5.0, iterations: int = 100, calibrate: bool = True, folds: int = 3):
        self.features, self.c, self.iterations, self.calibrate, self.folds = features, c, iterations, calibrate, folds
        self.classes: list[str] = []
        self.thresholds: dict[str, float] = {}
        self.maps: list[list[tuple[list[float], list[float]]]] = []

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        """df with the grams' (1 + ln tf) * idf, scaled to length 1, as `_x`. All of it runs in the JVM, so no Python worker holds batches of texts."""
        counted = self.vocabulary.transform(df.withColumn("_grams", char_wb_ngrams(F.coalesce(F.col(text), F.lit(""))))).drop("_grams")
        tf = F.unwrap_udt("_tf")
        damped = F.struct(*(tf[k].alias(k) for k in ("type", "size", "indices")), F.transform(tf["values"], lambda n: 1 + F.log(n)).alias("values"))
        # SQL makes a sparse vector of a struct only by way of JSON; doubles come back from it exactly
        vector = F.from_json(F.to_json(F.struct(damped.alias("x"))), StructType([StructField("x", VectorUDT())]), {"mode": "FAILFAST"})["x"]
        weighted = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_tf", outputCol="_weighted").transform(counted.withColumn("_tf", vector))
        scaled = Normalizer(inputCol="_weighted", outputCol="_x").transform(weighted).drop("_tf", "_weighted")
        return scaled.withColumn("_x", C.once(F.col("_x")))

    def _fit(self, df: DataFrame, n: int) -> LogisticRegressionModel:
        return LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=self.iterations).fit(df)

    def fit(self, df: DataFrame, text: str = "text", label: str = "lang") -> CharNgramModel:
        self.classes = sorted(r[0] for r in df.select(label).distinct().collect())
        code = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)).cast("double") - 1
        df = df.withColumn("_y", code).withColumn("_fold", F.pmod(F.xxhash64(text), F.lit(self.folds)))
        grams = df.withColumn("_grams", char_wb_ngrams(F.coalesce(F.col(text), F.lit(""))))
        self.vocabulary = CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=self.features, minDF=2, maxDF=0.95).fit(grams)
        n = df.count()
        self.idf = IDF(inputCol="_tf").fit(self.vocabulary.transform(grams)).idf.toArray() + 1
        ready = self._vectors(df, text).select("_x", "_y", "_fold").cache()
        self.models = [self._fit(ready, n)]
        if self.calibrate:
            self.models, self.maps = [], []
            for k in range(self.folds):
                model = self._fit(ready.where(F.col("_fold") != k), n)
                held = model.transform(ready.where(F.col("_fold") == k)).select("_y", vector_to_array("probability").alias("p"))
                self.models.append(model)
                self.maps.append(self._isotonic(held))
        ready.unpersist()
        return self

    def _isotonic(self, held: DataFrame) -> list[tuple[list[float], list[float]]]:
        from pyspark.ml.regression import IsotonicRegression

        out = []
        for c in range(len(self.classes)):
            model = IsotonicRegression(featuresCol="f", labelCol="l").fit(held.select(F.get("p", F.lit(c)).alias("f"), (F.col("_y") == c).cast("double").alias("l")))
            out.append((model.boundaries.toArray().tolist(), model.predictions.toArray().tolist()))
        return out

    def transform(self, df: DataFrame, text: str = "text", output: str = "probs") -> DataFrame:
        out = self._vectors(df, text)
        for k, model in enumerate(self.models):
            out = model.transform(out).withColumn(f"_p{k}", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")
        maps = self.maps

        @F.pandas_udf("array<double>")
        def calibrated(frame: pd.DataFrame) -> pd.Series:
            total = 0
            for k, name in enumerate(frame.columns):
                p = np.stack(frame[name].to_numpy()) if len(frame) else np.zeros((0, 1))
                p = np.stack([np.interp(p[:, c], *maps[k][c]) if maps[k][c][0] else p[:, c] for c in range(p.shape[1])], axis=1)
                sums = p.sum(axis=1, keepdims=True)
                total = total + np.where(sums > 0, p / np.where(sums > 0, sums, 1), 1 / max(1, p.shape[1]))
            return pd.Series(list(total / len(frame.columns)))

        names = [f"_p{k}" for k in range(len(self.models))]
        return out.withColumn(output, calibrated(F.struct(*names)) if maps else F.col(names[0])).drop("_x", *names)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        out = self.transform(df, text, "probs").withColumn("predicted_lang", F.get(F.array(*map(F.lit, self.classes)), F.array_position("probs", F.array_max("probs")).cast("int") - 1))
        default = F.create_map(*[F.lit(x) for c in self.classes for x in (c, float(self.thresholds.get(c, 0.5)))])
        return out.withColumn("confidence", F.array_max("probs")).withColumn("is_confident", F.col("confidence") >= default[F.col("predicted_lang")])

    def top_features(self, n: int = 20) -> dict[str, list[tuple[str, float]]]:
        """The n-grams with the largest coefficients of each class, averaged over the folds."""
        matrix = sum(m.coefficientMatrix.toArray() for m in self.models) / len(self.models)
        words = self.vocabulary.vocabulary
        return {c: [(words[k], float(matrix[row, k])) for k in np.argsort(-matrix[row], kind="stable")[:n]] for row, c in enumerate(self.classes)}

    def save(self, path: str) -> None:
        self.vocabulary.write().overwrite().save(f"{path}/vocabulary")
        for k, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model-{k}")
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        side = {"classes": self.classes, "thresholds": self.thresholds, "maps": self.maps, "idf": self.idf.tolist(), "models": len(self.models)}
        spark.createDataFrame([(json.dumps(side),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")

    @classmethod
    def load(cls, spark, path: str) -> CharNgramModel:
        out, side = cls(), json.loads(spark.read.text(f"{path}/side").first()[0])
        out.classes, out.thresholds, out.maps, out.idf = side["classes"], side["thresholds"], side["maps"], np.array(side["idf"])
        out.vocabulary = CountVectorizerModel.load(f"{path}/vocabulary")
        out.models = [LogisticRegressionModel.load(f"{path}/model-{k}") for k in range(side["models"])]
        return out


class WordNgramModel:
    """Hashed word n-grams and multinomial regression: stands in for fastText's supervised mode, whose library is not assumed."""

    def __init__(self, features: int = 1 << 18, iterations: int = 50, most: int = 3):
        self.features, self.iterations, self.most, self.classes = features, iterations, most, []

    def _vectors(self, df: DataFrame, text: str) -> DataFrame:
        grams = df.withColumn("_grams", word_ngrams(one_line(F.coalesce(F.col(text), F.lit(""))), self.most))
        return HashingTF(numFeatures=self.features, inputCol="_grams", outputCol="_x").transform(grams).drop("_grams")

    def fit(self, df: DataFrame, text: str = "text", label: str = "lang") -> WordNgramModel:
        self.classes = sorted(r[0] for r in df.select(label).distinct().collect())
        code = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)).cast("double") - 1
        self.model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=self.iterations, regParam=1e-4).fit(self._vectors(df.withColumn("_y", code), text))
        return self

    def transform(self, df: DataFrame, text: str = "text", output: str = "probs") -> DataFrame:
        return self.model.transform(self._vectors(df, text)).withColumn(output, vector_to_array("probability")).drop("_x", "probability", "rawPrediction", "prediction")

    def save(self, path: str) -> None:
        _save(self.model, {"classes": self.classes, "features": self.features, "most": self.most}, path)

    @classmethod
    def load(cls, spark, path: str) -> WordNgramModel:
        model, side = _load(spark, path)
        out = cls(side["features"], most=side["most"])
        out.model, out.classes = model, side["classes"]
        return out


class BatchScorer:
    """Any batch function texts -> (n, classes) array as a scorer, loaded once a worker: the place for a transformer."""

    def __init__(self, make: Callable[[], Callable[[np.ndarray], np.ndarray]], classes: list[str], batch: int = 32):
        self.make, self.classes, self.batch = make, classes, batch

    def transform(self, df: DataFrame, text: str = "text", output: str = "probs") -> DataFrame:
        from pyspark.ml.functions import predict_batch_udf
        from pyspark.sql.types import ArrayType, DoubleType

        return df.withColumn(output, predict_batch_udf(self.make, return_type=ArrayType(DoubleType()), batch_size=self.batch)(text))


class Stacking:
    """A meta-learner on the concatenated probabilities of several scorers; a prediction needs the same columns in the same order."""

    def __init__(self, iterations: int = 100, penalty: float = 1e-3):
        self.iterations, self.penalty, self.classes = iterations, penalty, []

    def fit(self, df: DataFrame, probs: list[str], label: str = "lang") -> Stacking:
        self.classes = sorted(r[0] for r in df.select(label).distinct().collect())
        code = F.array_position(F.array(*map(F.lit, self.classes)), F.col(label)).cast("double") - 1
        ready = df.select(array_to_vector(F.concat(*probs)).alias("_x"), code.alias("_y"))
        self.model = LogisticRegression(featuresCol="_x", labelCol="_y", family="multinomial", maxIter=self.iterations, regParam=self.penalty).fit(ready)
        return self

    def transform(self, df: DataFrame, probs: list[str], output: str = "probs") -> DataFrame:
        joined = df.withColumn("_x", array_to_vector(F.concat(*probs)))
        return self.model.transform(joined).withColumn(output, vector_to_array("probability")).drop("_x", "probability", "rawPrediction", "prediction")

    def save(self, path: str) -> None:
        _save(self.model, {"classes": self.classes}, path)

    @classmethod
    def load(cls, spark, path: str) -> Stacking:
        out = cls()
        out.model, side = _load(spark, path)
        out.classes = side["classes"]
        return out


def _side(spark, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/side")


def _save(model: LogisticRegressionModel, side: dict, path: str) -> None:
    from pyspark.sql import SparkSession

    model.write().overwrite().save(f"{path}/model")
    _side(SparkSession.getActiveSession(), side, path)


def _load(spark, path: str) -> tuple[LogisticRegressionModel, dict]:
    return LogisticRegressionModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/side").first()[0])


def save_vote(spark, weights: dict[str, float], models: dict[str, str], path: str) -> None:
    """The weights of a vote and where its models are."""
    _side(spark, {"weights": weights, "models": models}, path)


def load_vote(spark, path: str) -> tuple[dict[str, float], dict[str, str]]:
    side = json.loads(spark.read.text(f"{path}/side").first()[0])
    return side["weights"], side["models"]
