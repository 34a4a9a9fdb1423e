"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scriptora.llm.common import SPACES, compact, fresh, materialise

SYMBOLS = "#*$%&|<>"
#: ASCII punctuation, symbols among it.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_types", "n_marks")
#: Dimensions of the vector that is judged; see vector().
DIMENSIONS = 3
#: A text of so many words counts half its squared deviation from its group's centre: short texts vary more by chance.
HALF_WORDS = 200
#: The share of a group's rows that an estimate fits, and the quantile beyond which a row is rejected.
HALF, QUANTILE = 0.5, 0.9999
#: Of a group's rows those over SPARE count against PRIOR rows of the estimate over all groups.
SPARE, PRIOR = 20, 50
#: Bins of a statistic a unit, for exact medians; cells of the grid a median absolute deviation, and how many of these it reaches.
BINS, CELLS, REACH = 2048, 8, 6
#: Random starts of an estimate, their seed, and the starts that go on to their end.
DRAWS, SEED, BEST = 40, 23, 6
#: Groups whose estimates are sent to all tasks at once; beyond that rows and estimates are joined by shuffling.
SENT = 200_000


def statistics(text: str) -> tuple[int, ...]:
    """STATS of a whole text; words are runs of other than ASCII white space."""
    data = text.encode()
    words = data.split()
    chars = len(text) - sum(map(text.count, SPACES.decode()))
    lines = [x for x in data.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        often, end = {g for g, k in Counter(grams).items() if k > 1}, 0
        for k, g in enumerate(grams):
            if g in often:
                repeated += k + 3 - max(end, k)
                end = k + 3
    marks = len(data) - len(data.translate(None, MARKS))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(set(words)), marks


def measure(df: DataFrame) -> DataFrame:
    """doc_id, lang, source and STATS of each row of df, from one pass over whole texts."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string())] + [(c, pa.int64()) for c in STATS])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([statistics(x or "") for x in b.column(3).to_pylist()], "i8").reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.string()), b.column(2).cast(pa.string()), *(pa.array(found[:, k]) for k in range(len(STATS)))], schema=schema)

    return compact(df.select(F.col("doc_id").cast("long"), "lang", "source", "text")).mapInArrow(task, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in STATS))


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def vector(of=F.col) -> list[Column]:
    """Statistics that vary in every text: log of the mean word length, log of the punctuation a character, and the log of different words by that of all (Herdan's C)."""
    words = F.greatest(of("n_words"), F.lit(2))
    return [F.log(F.greatest(of("word_chars"), F.lit(1)) / words), F.log((of("n_marks") + 1) / (of("word_chars") + 1)), F.log(F.greatest(of("n_types"), F.lit(1))) / F.log(words)]


def weight(of=F.col) -> Column:
    return F.sqrt(of("n_words") / (of("n_words") + HALF_WORDS))


def chi2_quantile(p: float, k: int) -> float:
    """By Wilson and Hilferty's cube root, right to about one per cent here."""
    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * (2 / (9 * k)) ** 0.5) ** 3


def consistency(half: float, k: int) -> float:
    """By what the covariance of the nearest part of normal rows has to be multiplied: that part over the chi-square share with k + 2 degrees below its quantile."""
    x = np.linspace(0, chi2_quantile(half, k), 20_001)[1:]
    density = x ** (k / 2) * np.exp(-x / 2) / (2 ** (k / 2 + 1) * math.gamma(k / 2 + 1))
    return half / float(((density[1:] + density[:-1]) / 2).sum() * (x[1] - x[0]))


def _moments(points: np.ndarray, weights: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    mean = weights @ points / weights.sum()
    gaps = points - mean
    return mean, (gaps * weights[:, None]).T @ gaps / weights.sum() + least * np.eye(points.shape[1])


def _nearest(distance: np.ndarray, weights: np.ndarray, want: float) -> np.ndarray:
    """The weights of the nearest points that come to `want`; points at the last distance that counts share what it has left."""
    order = np.argsort(distance, kind="stable")
    upto = np.cumsum(weights[order])
    last = distance[order[min(int(np.searchsorted(upto, want)), len(order) - 1)]]
    out, edge = np.where(distance < last, weights, 0.0), distance == last
    out[edge] = weights[edge] * min(1.0, (want - out.sum()) / weights[edge].sum())
    return out


def _medians(points: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = []
    for column in points.T:
        order = np.argsort(column, kind="stable")
        out.append(column[order[np.searchsorted(2 * np.cumsum(weights[order]), weights.sum())]])
    return np.array(out)


def concentrated(points: np.ndarray, weights: np.ndarray, half: float = HALF, least: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of those rows, `half` of all, whose covariance has the smallest determinant that concentration finds.

    points are rows, each as often as its weight says. Starts that repeat: the
    medians with the median deviations alone, with the correlation of ranks, of
    normal scores and of hyperbolic tangents, and seeded draws of k + 1 rows.
    All take two concentration steps, the nearest part by the last mean and
    covariance giving the next, and the best of them go on until the
    determinant falls no more; the smallest one counts. Only `least`, for
    inversion, is added to the variances.
    """
    weights, k = weights.astype(float), points.shape[1]
    want = max(half * weights.sum(), min(weights.sum(), k + 1.0))
    centre = _medians(points, weights)
    spread = 1.4826 * _medians(abs(points - centre), weights) + least**0.5
    z, ranks, scores = (points - centre) / spread, np.empty(points.shape), np.empty(points.shape)
    for c in range(k):
        _, at = np.unique(points[:, c], return_inverse=True)
        own = np.bincount(at, weights)
        below = (np.cumsum(own) - own / 2) / weights.sum()
        ranks[:, c], scores[:, c] = below[at], np.array([NormalDist().inv_cdf(min(max(x, 1e-4), 1 - 1e-4)) for x in below])[at]
    found = [(centre, np.diag(spread**2))]
    for start in (ranks, scores, np.tanh(z)):
        _, own = _moments(start, weights, 1e-9)
        found.append((centre, own / np.sqrt(np.outer(np.diag(own), np.diag(own))) * np.outer(spread, spread) + least * np.eye(k)))
    draw = np.random.default_rng(SEED)
    for _ in range(DRAWS):
        some = draw.choice(len(points), k + 1, p=weights / weights.sum())
        found.append(_moments(points[some], np.ones(k + 1), least))

    def step(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gaps = points - mean
        return _moments(points, _nearest(np.einsum("ij,ij->i", gaps, np.linalg.solve(cov, gaps.T).T), weights, want), least)

    tried = sorted(((step(*step(*x))) for x in found), key=lambda x: float(np.linalg.det(x[1])))[:BEST]
    ends = []
    for mean, cov in tried:
        smallest, now = math.inf, float(np.linalg.det(cov))
        while now < smallest * (1 - 1e-9):
            smallest = now
            mean, cov = step(mean, cov)
            now = float(np.linalg.det(cov))
        ends.append((now, mean, cov))
    _, mean, cov = min(ends, key=lambda x: x[0])
    return mean, cov


def minimum_covariance(points: np.ndarray, weights: np.ndarray, half: float = HALF, least: float = 1e-9, inner: float = 0.975) -> tuple[np.ndarray, np.ndarray]:
    """The minimum-covariance-determinant estimate: the concentrated rows' covariance, scaled by the median distance to be right for normal rows, tells the rows within the `inner` quantile, whose mean and covariance, scaled likewise, are the result."""
    mean, cov = concentrated(points, weights, half, least)
    k, weights = points.shape[1], weights.astype(float)
    gaps = points - mean
    distances = np.einsum("ij,ij->i", gaps, np.linalg.solve(cov, gaps.T).T)
    near = distances <= max(1.0, float(_medians(distances[:, None], weights)[0]) / chi2_quantile(0.5, k)) * chi2_quantile(inner, k)
    mean, cov = _moments(points, np.where(near, weights, 0.0), 0.0)
    return mean, cov * consistency(inner, k) + least * np.eye(k)


def _joined(rows: DataFrame, table: DataFrame, groups: int, lang: str = "lang", source: str = "source") -> DataFrame:
    """rows with what table (g_lang, g_source, ...) has for their group; nothing where it has none."""
    return rows.join(F.broadcast(table) if groups <= SENT else table, F.col(lang).eqNullSafe(F.col("g_lang")) & F.col(source).eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")


def _halfway(hist: DataFrame, *by: str) -> DataFrame:
    """The median bin of each group of a histogram (..., bin, n), with the group's rows as `rows`."""
    own = Window.partitionBy(*by)
    return hist.withColumn("upto", F.sum("n").over(own.orderBy("bin"))).withColumn("rows", F.sum("n").over(own)).where("2 * upto >= rows").groupBy(*by).agg(F.min("bin").alias("bin"), F.max("rows").alias("rows"))


def _share(rows: Column) -> Column:
    more = F.greatest(F.lit(0), rows - SPARE)
    return more / (more + PRIOR)


def fit(stats: DataFrame, half: float = HALF) -> tuple[DataFrame, int] | None:
    """An estimate for each (lang, source) from a written table of statistics: (g_lang, g_source, centre, precision), and how many there are; None if no row passes the base rules.

    Exact medians come from histograms of fixed bins. A row's deviation from
    its group's medians, less for short texts, falls into a cell of a grid whose
    unit is the median absolute deviation within groups; counts of cells are
    combined before the shuffle, and a group has no more cells than the grid,
    whatever its share of the rows, so one task holds them and takes the
    concentration steps to their end. The grid's own variance is all that is
    added. A group's estimate counts by its rows over SPARE against PRIOR rows
    of the estimate over all groups, so small groups lean on the latter without
    a switch. The driver gets three medians, three units and one estimate.
    """
    spark, own = stats.sparkSession, ["lang", "source"]
    rows = stats.where(~base_failed())
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(x * BINS).alias("bin")) for k, x in enumerate(vector()))))
    hist = materialise(rows.select(*own, bins.alias("x")).groupBy(*own, "x.k", "x.bin").agg(F.count("*").alias("n")), "histograms")
    middle = {r["k"]: r["bin"] for r in _halfway(hist.groupBy("k", "bin").agg(F.sum("n").alias("n")), "k").collect()}
    if not middle:
        return None
    every = F.create_map(*[F.lit(x) for k, v in middle.items() for x in (k, float(v))])
    medians = _halfway(hist, *own, "k").select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), F.col("k").alias("g_k"), "rows", (_share(F.col("rows")) * F.col("bin") + (1 - _share(F.col("rows"))) * every[F.col("k")]).alias("centre"))
    medians = materialise(medians, "medians")
    centres = medians.groupBy("g_lang", "g_source").agg(F.max("rows").alias("rows"), *(F.max(F.when(F.col("g_k") == k, (F.col("centre") + 0.5) / BINS)).alias(f"m{k}") for k in range(DIMENSIONS)))
    groups = centres.count()
    apart = hist.join(F.broadcast(medians) if groups <= SENT else medians, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("k") == F.col("g_k")))
    apart = apart.groupBy("k", F.round(F.abs(hist["bin"] - F.col("centre"))).cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    unit = {r["k"]: max(1, r["bin"]) / BINS for r in _halfway(apart, "k").collect()}

    place = [F.greatest(F.lit(-REACH * CELLS), F.least(F.lit(REACH * CELLS), F.round((x - F.col(f"m{k}")) * weight() * (CELLS / unit[k])).cast("int"))).alias(f"c{k}") for k, x in enumerate(vector())]
    names = [f"c{k}" for k in range(DIMENSIONS)]
    cells = materialise(_joined(rows, centres, groups).select(*own, *place).groupBy(*own, *names).agg(F.count("*").alias("n")), "cells")
    least = 1 / 12  # the variance within a cell, in cells

    def pooled(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(names)
        mean, cov = minimum_covariance(x[names].to_numpy(float), x["n"].to_numpy(), half, least)
        return pd.DataFrame({"mean": [mean.tolist()], "cov": [cov.ravel().tolist()]})

    of_all = cells.groupBy(*names).agg(F.sum("n").alias("n")).groupBy(F.lit(0).alias("all")).applyInPandas(pooled, "mean array<double>, cov array<double>").first()
    mean_all, cov_all = np.array(of_all["mean"]), np.array(of_all["cov"]).reshape(DIMENSIONS, DIMENSIONS)
    scale = np.array([unit[k] / CELLS for k in range(DIMENSIONS)])

    def estimate(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(names)
        points, weights = x[names].to_numpy(float), x["n"].to_numpy()
        more = max(0.0, float(weights.sum() - SPARE))
        share = more / (more + PRIOR)
        mean, cov = minimum_covariance(points, weights, half, least) if share else (mean_all, cov_all)
        mean, cov = share * mean + (1 - share) * mean_all, share * cov + (1 - share) * cov_all
        return pd.DataFrame({"e_lang": [x["lang"].iloc[0]], "e_source": [x["source"].iloc[0]], "mean": [(mean * scale).tolist()], "precision": [np.linalg.inv(cov * np.outer(scale, scale)).ravel().tolist()]})

    found = cells.groupBy(*own).applyInPandas(estimate, "e_lang string, e_source string, mean array<double>, precision array<double>")
    table = centres.join(found, F.col("g_lang").eqNullSafe(F.col("e_lang")) & F.col("g_source").eqNullSafe(F.col("e_source"))).select("g_lang", "g_source", F.array(*(F.col(f"m{k}") for k in range(DIMENSIONS))).alias("centre"), "mean", "precision")
    return materialise(table, "estimates"), groups


def distance(of=F.col) -> Column:
    """Squared Mahalanobis distance of a row that has its group's centre, mean and precision."""
    gaps = [(x - F.col("centre")[k]) * weight(of) - F.col("mean")[k] for k, x in enumerate(vector(of))]
    return sum((gaps[a] * gaps[b] * F.col("precision")[DIMENSIONS * a + b] for a in range(DIMENSIONS) for b in range(DIMENSIONS)), F.lit(0.0))


def judge(df: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of df (doc_id, text, lang, source).

    Null texts have no words. Null languages and sources are values like any
    other. Rows stay as they are, repeated ones too; no rows give no rows.
    """
    return _judged(materialise(measure(df), "statistics"), quantile)


def _judged(stats: DataFrame, quantile: float) -> DataFrame:
    found, told = fit(stats), stats.withColumn("base_failed", base_failed())
    if found:
        near = F.coalesce(distance() <= chi2_quantile(quantile, DIMENSIONS), F.lit(True))
        told = _joined(told, *found).withColumn("kept", ~F.col("base_failed") & near)
    else:
        told = told.withColumn("kept", F.lit(False))
    return told.select("doc_id", *STATS[:5], "base_failed", "kept")


def kept_documents(df: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of df that judge keeps. The texts are read twice and, while groups are few enough to be sent, never shuffled."""
    found = fit(materialise(measure(df), "statistics"))
    if not found:
        return df.limit(0)
    name = fresh(df.columns, "_stats")
    kind = pa.struct([(c, pa.int64()) for c in STATS] + [("lang", pa.string()), ("source", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([statistics(x or "") for x in b.column("text").to_pylist()], "i8").reshape(-1, len(STATS))
            told = pa.StructArray.from_arrays([*(pa.array(own[:, k]) for k in range(len(STATS))), b.column("lang").cast(pa.string()), b.column("source").cast(pa.string())], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*b.columns, told], [*b.schema.names, name])

    told = StructType([*df.schema.fields, StructField(name, StructType.fromDDL(", ".join(f"{c} long" for c in STATS) + ", lang string, source string"))])
    of = lambda c: F.col(name)[c]
    own = compact(df).mapInArrow(task, told).where(~base_failed(of)).select(F.struct(*df.columns).alias("_row"), name)
    near = _joined(own, *found, f"{name}.lang", f"{name}.source").where(distance(of) <= chi2_quantile(quantile, DIMENSIONS))
    return near.select("_row.*")
