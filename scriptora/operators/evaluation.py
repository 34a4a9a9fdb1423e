"""Evaluation tables from rows of true and predicted labels, all by grouped counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptora.functions import registry as R


def confusion(df: DataFrame, true: str = "true", pred: str = "pred") -> DataFrame:
    """(true, pred, n). A missing prediction counts as its own class, the empty string."""
    return df.groupBy(F.col(true).alias("true"), F.coalesce(F.col(pred), F.lit("")).alias("pred")).agg(F.count("*").alias("n"))


def normalised(counts: DataFrame) -> DataFrame:
    total = F.greatest(F.sum("n").over(Window.partitionBy("true")), F.lit(1))
    return counts.withColumn("share", F.col("n") / total)


def class_report(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of every true or predicted class; divisions by zero give 0."""
    one = counts.select(F.explode(F.array(F.struct(F.col("true").alias("c"), F.lit(1).alias("t"), (F.col("true") == F.col("pred")).cast("int").alias("hit")), F.struct(F.col("pred").alias("c"), F.lit(0).alias("t"), F.lit(0).alias("hit")))).alias("x"), "n")
    sums = one.groupBy(F.col("x.c").alias("class")).agg(F.sum(F.when(F.col("x.t") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("x.t") == 0, F.col("n")).otherwise(0)).alias("predicted"), F.sum(F.when(F.col("x.hit") == 1, F.col("n")).otherwise(0)).alias("tp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = sums.withColumn("precision", ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2.0 * F.col("tp"), F.col("predicted") + F.col("support"))).select("class", "precision", "recall", "f1", "support")


def full_report(counts: DataFrame) -> DataFrame:
    """class_report with the rows accuracy, macro avg and weighted avg below; in the first all ratios are the accuracy."""
    report, total = class_report(counts), F.sum("support")
    hits = counts.agg(F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"), F.sum("n").alias("support"))
    share = F.col("hits") / F.col("support")
    accuracy = hits.select(F.lit("accuracy").alias("class"), share.alias("precision"), share.alias("recall"), share.alias("f1"), "support")
    ratios = ("precision", "recall", "f1")
    macro = report.agg(*(F.avg(c).alias(c) for c in ratios), total.alias("support")).select(F.lit("macro avg").alias("class"), *ratios, "support")
    weighted = report.agg(*((F.sum(F.col(c) * F.col("support")) / total).alias(c) for c in ratios), total.alias("support")).select(F.lit("weighted avg").alias("class"), *ratios, "support")
    return report.unionByName(accuracy).unionByName(macro).unionByName(weighted)


def compare_models(found: dict[str, DataFrame]) -> DataFrame:
    """A row for each model from its rows (true, pred): accuracy and averages."""
    rows = [overall(confusion(df)).withColumn("model", F.lit(name)) for name, df in found.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out.select("model", "accuracy", "macro_f1", "weighted_f1", "n_samples")


def overall(counts: DataFrame) -> DataFrame:
    """One row: accuracy, macro and weighted averages over true and predicted classes, to six digits."""
    total = counts.agg(F.sum("n").alias("n_samples"), F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)).alias("hits"), F.countDistinct("true").alias("n_classes"))
    macro = class_report(counts).agg(F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"))
    joined = total.crossJoin(macro)  # one row times one row
    return joined.select(F.round(F.col("hits") / F.col("n_samples"), 6).alias("accuracy"), *(F.round(c, 6).alias(c) for c in ("macro_f1", "weighted_f1", "macro_precision", "macro_recall")), "n_samples", "n_classes")


def f1_bands(report: DataFrame) -> DataFrame:
    return report.withColumn("band", F.when(F.col("f1") > 0.95, "high").when(F.col("f1") > 0.85, "medium").otherwise("low")).orderBy("f1", "class")


def _binned(df: DataFrame, conf: str, bins: int) -> DataFrame:
    """Bins [lo, hi) with lo = k / bins; a confidence of 1 is in none."""
    edges = F.array(*[F.lit(k / bins) for k in range(bins + 1)])
    at = F.size(F.filter(edges, lambda e: e <= F.col(conf))) - 1
    return df.withColumn("bin", F.when((F.col(conf) >= 0) & (F.col(conf) < 1), at))


def calibration_error(df: DataFrame, conf: str = "confidence", correct: str = "correct", bins: int = 15) -> DataFrame:
    """One row: ece, mean_confidence, high_confidence_ratio. Rows in no bin still count in the denominator."""
    by = _binned(df, conf, bins).groupBy("bin").agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"), F.sum(conf).alias("s"), F.count_if(F.col(conf) >= 0.9).alias("h"))
    return by.agg(F.round(F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("n") * F.abs(F.col("c") - F.col("a")))), F.lit(0.0)) / F.sum("n"), 6).alias("ece"), F.round(F.sum("s") / F.sum("n"), 4).alias("mean_confidence"), F.round(F.sum("h") / F.sum("n"), 4).alias("high_confidence_ratio"))


def reliability(df: DataFrame, conf: str = "confidence", correct: str = "correct", bins: int = 15) -> DataFrame:
    """A row for each bin; empty ones have no accuracy and their middle for a confidence."""
    by = _binned(df, conf, bins).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(F.col(correct).cast("int")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(by, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", (F.col("bin") + 0.5) / bins).alias("confidence"), "accuracy")


def confidence_histogram(df: DataFrame, conf: str = "confidence", correct: str = "correct", bins: int = 30) -> DataFrame:
    """Right and wrong rows in `bins` equal steps from the smallest to the largest confidence."""
    ends = df.agg(F.min(conf).alias("lo"), F.max(conf).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(conf) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return df.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count_if(F.col(correct)).alias("n_correct"), F.count_if(~F.col(correct)).alias("n_wrong"))  # one row is added


def error_summary(counts: DataFrame, limit: int = 50) -> DataFrame:
    """The most frequent confusions, with names where the registry has them."""
    return counts.where(F.col("true") != F.col("pred")).orderBy(F.desc("n"), "true", "pred").limit(limit).select(F.col("true").alias("true_lang"), F.col("pred").alias("pred_lang"), F.col("n").alias("count"), R.lookup(F.col("true"), 1).alias("true_name"), R.lookup(F.col("pred"), 1).alias("pred_name"))


def error_rate(counts: DataFrame) -> DataFrame:
    by = counts.groupBy(F.col("true").alias("lang")).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("true") != F.col("pred"), F.col("n")).otherwise(0)).alias("errors"))
    return by.withColumn("error_rate", F.col("errors") / F.col("total"))


def error_samples(df: DataFrame, n: int = 5, true: str = "true", pred: str = "pred", text: str = "text", key: str = "doc_id") -> DataFrame:
    """The first n errors of each confusion by id, texts cut to 200 characters."""
    wrong = df.select(F.col(true).alias("true_lang"), F.coalesce(F.col(pred), F.lit("")).alias("pred_lang"), key, F.substring(text, 1, 200).alias("text")).where(F.col("true_lang") != F.col("pred_lang"))
    return wrong.withColumn("rank", F.row_number().over(Window.partitionBy("true_lang", "pred_lang").orderBy(key))).where(F.col("rank") <= n)


def confidence_thresholds(probs: DataFrame, target: float = 0.95, compat: bool = False) -> DataFrame:
    """Per language the first of 50 thresholds from 0.3 to 0.99 whose precision reaches target, else 0.5.

    probs: (true, lang, p), a row for each row and class. With compat every
    row at or over the threshold counts as right, so the first threshold with
    any such row is it. Rows are counted by step first: the grid is joined to
    counts, not to rows.
    """
    grid = [0.3 + k * (0.99 - 0.3) / 49 for k in range(50)]
    step = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: t <= F.col("p")))
    by = probs.groupBy("lang", step.alias("step")).agg(F.count("*").alias("n"), (F.count("*") if compat else F.count_if(F.col("true") == F.col("lang"))).alias("hit")).where("step > 0")
    above = Window.partitionBy("lang").orderBy(F.desc("step"))
    ranked = by.withColumn("n", F.sum("n").over(above)).withColumn("hit", F.sum("hit").over(above))
    # Steps without rows of their own have the counts of the next step that has some.
    first = ranked.withColumn("low", F.coalesce(F.lag("step").over(Window.partitionBy("lang").orderBy("step")), F.lit(0)) + 1).where(F.col("hit") / F.col("n") >= target)
    best = first.groupBy("lang").agg(F.min("low").alias("low"))
    return probs.select("lang").distinct().join(best, "lang", "left").select("lang", F.coalesce(F.get(F.array(*map(F.lit, grid)), (F.col("low") - 1).cast("int")), F.lit(0.5)).alias("threshold"))
