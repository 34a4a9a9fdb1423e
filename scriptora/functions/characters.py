"""Character statistics of a text, derived from one array of its different characters and their counts.

The array keeps the order of first occurrence, so ties between scripts fall to
the one that the text shows first. Everything stays in one row: no explosion,
no shuffle, no Python.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.functions import classes as K


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is evaluated once a row, however often the body names it: a lambda's variable holds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tally(text: Column) -> Column:
    """array<struct<c,n>>: each different character with its count."""
    text = F.coalesce(text, F.lit(""))
    different = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    return F.transform(different, lambda c: F.struct(c.alias("c"), (F.length(text) - F.length(F.replace(text, c, F.lit("")))).cast("long").alias("n")))


def total(chars: Column, where: Callable[[Column], Column] | None = None) -> Column:
    own = F.filter(chars, lambda x: where(x["c"])) if where else chars
    return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def is_letter(c: Column) -> Column:
    return c.rlike(f"^[{K.LETTER}]$")


def is_digit(c: Column) -> Column:
    return c.rlike(f"^[{K.DIGIT}]$")


def is_punctuation(c: Column) -> Column:
    return c.rlike(f"^[{K.PUNCTUATION}]$")


def is_space(c: Column) -> Column:
    return c.rlike(rf"^[{K.SPACE}]\z")


def entropy(chars: Column) -> Column:
    """Shannon entropy in bits; 0 for an empty text."""
    n = total(chars).cast("double")
    inner = F.aggregate(chars, F.lit(0.0), lambda a, x: a + x["n"] * F.log2(x["n"].cast("double")))
    return F.when(n > 0, F.log2(n) - inner / n).otherwise(F.lit(0.0))


def _case(of: Callable[[str], str], c: Column, default: Callable[[Column], Column]) -> Column:
    out = None
    point = F.ascii(c)
    for name, ranges in of:
        inside = None
        for lo, hi in ranges:
            inside = point.between(lo, hi) if inside is None else inside | point.between(lo, hi)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out.otherwise(default(c))


def script_of(c: Column) -> Column:
    """Table A; Other if none."""
    return _case(K.SCRIPTS, c, lambda _: F.lit("Other"))


def block_of(c: Column) -> Column:
    """Table B; Unknown if none."""
    return _case([(n, [(lo, hi)]) for lo, hi, n in K.BLOCKS], c, lambda _: F.lit("Unknown"))


def block_name(c: Column) -> Column:
    """Table B; a name with the code point if none."""
    return _case([(n, [(lo, hi)]) for lo, hi, n in K.BLOCKS], c, lambda c: F.concat(F.lit("U+"), F.when(F.ascii(c) < 0x10000, F.lpad(F.hex(F.ascii(c)), 4, "0")).otherwise(F.hex(F.ascii(c))), F.lit(" (unknown block)")))


def by_name(chars: Column, name: Callable[[Column], Column], where: Callable[[Column], Column] | None = None) -> Column:
    """array<struct<k,n>>: counts by the name of a character, in order of first occurrence."""
    own = F.filter(chars, lambda x: where(x["c"])) if where else chars
    return F.transform(own, lambda x: F.struct(name(x["c"]).alias("k"), x["n"].alias("n")))


def summed(named: Column) -> Column:
    """array<struct<k,n>> with each name once."""
    return F.transform(F.array_distinct(F.transform(named, lambda x: x["k"])), lambda k: F.struct(k.alias("k"), F.aggregate(F.filter(named, lambda x: x["k"] == k), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n")))


def shares(counts: Column) -> Column:
    """map<name,share> of counts by name."""
    n = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return F.map_from_entries(F.transform(counts, lambda x: F.struct(x["k"], x["n"].cast("double") / n)))


def largest(counts: Column) -> Column:
    """The name with the largest count, the first such; Unknown if there is none."""
    most = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: F.greatest(a, x["n"]))
    return F.coalesce(F.get(F.filter(counts, lambda x: x["n"] == most), F.lit(0))["k"], F.lit("Unknown"))


def map_max(shares_: Column) -> Column:
    return F.coalesce(F.array_max(F.map_values(shares_)), F.lit(0.0))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{K.SPACE}]+"), lambda w: w != "")


def class_counts(text: Column) -> dict[str, Column]:
    """Characters, letters, digits, punctuation and space of a text: one replacement for each class, whatever the text's characters."""
    text = F.coalesce(text, F.lit(""))
    kept = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]+", "")).cast("long")
    return {"n_chars": F.length(text).cast("long"), "n_alpha": kept(K.LETTER), "n_digits": kept(K.DIGIT), "n_punct": kept(K.PUNCTUATION), "n_spaces": kept(K.SPACE)}


def once(value: Column) -> Column:
    """A value that no later filter or expression evaluates again: it comes out of a one-element array."""
    return F.explode(F.array(value))


def quality_score(n: Column, alpha: Column, script_shares: Column) -> Column:
    """0.3 share of letters, 0.4 share of the largest script, 0.3 length up to 100 characters; 0 for an empty text."""
    score = 0.3 * (alpha / F.greatest(n, F.lit(1))) + 0.4 * map_max(script_shares) + 0.3 * F.least(F.lit(1.0), n / 100.0)
    return F.when(n > 0, score).otherwise(F.lit(0.0))


def with_text_features(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the sixteen features of each text as columns."""
    staged = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_chars", tally(F.col("_t")))
    staged = staged.withColumn("_scripts", by_name(F.col("_chars"), script_of, is_letter)).withColumn("_scripts", summed(F.col("_scripts"))).withColumn("_words", words(F.col("_t")))
    chars = F.col("_chars")
    staged = staged.withColumns({
        **class_counts(F.col("_t")),
        "dominant_script": largest(F.col("_scripts")), "script_distribution": shares(F.col("_scripts")), "script_count": F.size("_scripts").cast("long"), "char_entropy": entropy(chars),
        "n_words": F.size("_words").cast("long"), "_word_chars": F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w)), "unique_chars": F.size("_chars").cast("long"),
    })
    n = F.greatest(F.col("n_chars"), F.lit(1))
    staged = staged.withColumns({
        "alpha_ratio": F.col("n_alpha") / n, "digit_ratio": F.col("n_digits") / n, "unique_char_ratio": F.col("unique_chars") / n,
        "is_mixed_script": (F.col("script_count") > 1) & (map_max(F.col("script_distribution")) < 0.95), "quality_score": quality_score(F.col("n_chars"), F.col("n_alpha"), F.col("script_distribution")),
        "avg_word_len": F.when(F.col("n_words") > 0, F.col("_word_chars") / F.col("n_words")).otherwise(0.0),
    })
    return staged.drop("_t", "_chars", "_scripts", "_words", "_word_chars", "unique_chars")


def char_script_name(char: Column) -> Column:
    """A character's script by its Unicode name: the first script of table A that the name contains, else the name's first word. Goes through Arrow; meant for tables of different characters."""
    names = {n.upper(): n for n, _ in K.SCRIPTS}

    @F.pandas_udf("string")
    def named(x: pd.Series) -> pd.Series:
        def one(c):
            name = unicodedata.name(c, "") if c else ""
            return next((own for upper, own in names.items() if upper in name), name.partition(" ")[0].capitalize() or "Unknown")

        return x.map(one)

    return named(char)
