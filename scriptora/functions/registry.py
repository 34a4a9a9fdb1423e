"""The twelve registered languages, as rows, a DataFrame and lookups."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptora.functions.classes import SCRIPTS

#: Code, name, script, ISO 639-1, label, direction, family, native name, romanization, languages of the same script.
LANGUAGES = [
    ("ben", "Bengali", "Bengali", "bn", 0, "LTR", "Indo-Aryan", "বাংলা", "ISO 15919", []),
    ("eng", "English", "Latin", "en", 1, "LTR", "Germanic", "English", None, []),
    ("guj", "Gujarati", "Gujarati", "gu", 2, "LTR", "Indo-Aryan", "ગુજરાતી", "ISO 15919", []),
    ("hin", "Hindi", "Devanagari", "hi", 3, "LTR", "Indo-Aryan", "हिन्दी", "IAST", ["mar"]),
    ("kan", "Kannada", "Kannada", "kn", 4, "LTR", "Dravidian", "ಕನ್ನಡ", None, []),
    ("mal", "Malayalam", "Malayalam", "ml", 5, "LTR", "Dravidian", "മലയാളം", None, []),
    ("mar", "Marathi", "Devanagari", "mr", 6, "LTR", "Indo-Aryan", "मराठी", "IAST", ["hin"]),
    ("ori", "Odia", "Odia", "or", 7, "LTR", "Indo-Aryan", "ଓଡ଼ିଆ", None, []),
    ("pan", "Punjabi", "Gurmukhi", "pa", 8, "LTR", "Indo-Aryan", "ਪੰਜਾਬੀ", None, []),
    ("tam", "Tamil", "Tamil", "ta", 9, "LTR", "Dravidian", "தமிழ்", None, []),
    ("tel", "Telugu", "Telugu", "te", 10, "LTR", "Dravidian", "తెలుగు", None, []),
    ("urd", "Urdu", "Arabic", "ur", 11, "RTL", "Indo-Aryan", "اردو", "ALA-LC", []),
]
CODES = [r[0] for r in LANGUAGES]
CODE_TO_LABEL = {r[0]: r[4] for r in LANGUAGES}
LABEL_TO_CODE = {r[4]: r[0] for r in LANGUAGES}
DRAVIDIAN = {r[0] for r in LANGUAGES if r[6] == "Dravidian"}
INDO_ARYAN = {r[0] for r in LANGUAGES if r[6] == "Indo-Aryan"}
DEVANAGARI = {r[0] for r in LANGUAGES if r[2] == "Devanagari"}
RTL = {r[0] for r in LANGUAGES if r[5] == "RTL"}
#: Pairs that share a script or look alike.
CONFUSABLE = [("hin", "mar"), ("tam", "mal"), ("kan", "tel"), ("hin", "urd"), ("ben", "ori")]

SCHEMA = (
    "code string, name string, script string, iso639_1 string, iso639_3 string, label_id int, unicode_ranges array<struct<lo:int,hi:int>>,"
    " direction string, family string, native_name string, romanization_scheme string, shares_script_with array<string>"
)


def registry(spark: SparkSession) -> DataFrame:
    """One row a language; twelve rows, safe to broadcast."""
    ranges = dict(SCRIPTS)
    return spark.createDataFrame([(c, n, s, i, c, k, ranges[s], d, f, v, r, o) for c, n, s, i, k, d, f, v, r, o in LANGUAGES], SCHEMA)


def lookup(code: Column, field: int) -> Column:
    """Field of LANGUAGES by code, null for an unknown one."""
    pairs = [F.lit(x) for x in chain.from_iterable((r[0], r[field]) for r in LANGUAGES)]
    return F.create_map(*pairs)[code]


def name_of(code: Column) -> Column:
    return F.coalesce(lookup(code, 1), code)


def script_of(code: Column) -> Column:
    return F.coalesce(lookup(code, 2), F.lit("Unknown"))


def direction_of(code: Column) -> Column:
    return F.coalesce(lookup(code, 5), F.lit("LTR"))


def corpus_code(iso: Column) -> Column:
    """The registered code of an ISO 639-1 one; any other stays as it is."""
    return F.coalesce(F.create_map(*[F.lit(x) for r in LANGUAGES for x in (r[3], r[0])])[iso], iso)


def char_in_script(char: Column, code: Column) -> Column:
    """Whether a character is in the ranges of a registered language."""
    point, out = F.ascii(char), F.lit(None).cast("boolean")
    for r in LANGUAGES:
        inside = F.lit(False)
        for lo, hi in dict(SCRIPTS)[r[2]]:
            inside = inside | point.between(lo, hi)
        out = F.when(code == r[0], inside).otherwise(out)
    return out
