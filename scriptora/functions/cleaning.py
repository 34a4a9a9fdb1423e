"""Cleaning steps, string column to string column; preprocess applies them in their fixed order."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptora.functions.classes import SPACE, ZERO_WIDTH

URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+|ftp://[^{SPACE}]+"
#: A literal pipe is allowed in the last part.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PUNCTUATION_RUN = r"([!?।॥,;.]){2,}"
#: Digits of nine scripts, 0 to 9 each. Arabic-Indic digits stay as they are.
INDIC_DIGITS = "०१२३४५६७८९" "০১২৩৪৫৬৭৮৯" "੦੧੨੩੪੫੬੭੮੯" "૦૧૨૩૪૫૬૭૮૯" "୦୧୨୩୪୫୬୭୮୯" "௦௧௨௩௪௫௬௭௮௯" "౦౧౨౩౪౫౬౭౮౯" "೦೧೨೩೪೫೬೭೮೯" "൦൧൨൩൪൫൬൭൮൯"
UPPER = "".join(map(chr, [*range(ord("A"), ord("Z") + 1), *range(0xC0, 0xD7)]))


@dataclass(frozen=True)
class Cleaning:
    """Which steps run; the collapse of punctuation runs always does."""

    unicode_form: str | None = "NFC"
    remove_zero_width: bool = True
    remove_html: bool = True
    remove_urls: bool = True
    remove_emails: bool = True
    normalize_numerals: bool = True
    normalize_whitespace: bool = True
    lowercase_latin: bool = False
    max_length: int | None = 2000


def normalize_unicode(text: Column, form: str = "NFC") -> Column:
    """Unicode normal form; Spark SQL has no such function, so this step alone goes through Arrow."""

    @F.pandas_udf("string")
    def normal(x: pd.Series) -> pd.Series:
        return x.map(lambda t: t if t is None or unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t))

    return normal(text)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, ZERO_WIDTH, "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, URL, " ")


def strip_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, " ")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, INDIC_DIGITS, "0123456789" * 9)


def collapse_punctuation(text: Column) -> Column:
    """A run of two or more becomes its last character."""
    return F.regexp_replace(text, PUNCTUATION_RUN, "$1")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_space(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def lower_latin(text: Column) -> Column:
    """A to Z and U+00C0 to U+00D6 only."""
    return F.translate(text, UPPER, UPPER.lower())


def preview(text: Column, n: int, dots: bool = True) -> Column:
    """The first n characters, with an ellipsis where there are more."""
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, F.lit("...")).otherwise("")) if dots else F.substring(text, 1, n)


def one_line(text: Column) -> Column:
    """As fastText's training files want it."""
    return collapse_space(text)


def preprocess(text: Column, how: Cleaning = Cleaning()) -> Column:
    """The steps in order; null gives an empty string."""
    out = F.coalesce(text, F.lit(""))
    steps = [
        (how.unicode_form, lambda t: normalize_unicode(t, how.unicode_form)), (how.remove_zero_width, strip_zero_width), (how.remove_html, strip_html), (how.remove_urls, strip_urls), (how.remove_emails, strip_emails),
        (how.normalize_numerals, ascii_digits), (True, collapse_punctuation), (how.normalize_whitespace, collapse_space), (how.lowercase_latin, lower_latin), (how.max_length, lambda t: F.substring(t, 1, how.max_length)),
    ]
    for on, step in steps:
        out = step(out) if on else out
    return out
