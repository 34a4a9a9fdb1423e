"""Inline texts of the scripts that the tables lack, for queries and their SQL alike."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

TEXTS = [
    ("hin", "यह किताब मेज़ पर रखी है और बच्चे पढ़ रहे हैं।"),
    ("mar", "मुले शाळेत जात आहेत आणि पुस्तक टेबलावर आहे."),
    ("ben", "বইটি টেবিলের উপর আছে এবং শিশুরা পড়ছে।"),
    ("guj", "પુસ્તક ટેબલ પર છે અને બાળકો વાંચે છે."),
    ("pan", "ਕਿਤਾਬ ਮੇਜ਼ ਉੱਤੇ ਹੈ ਅਤੇ ਬੱਚੇ ਪੜ੍ਹ ਰਹੇ ਹਨ।"),
    ("ori", "ବହିଟି ଟେବୁଲ ଉପରେ ଅଛି ଏବଂ ପିଲାମାନେ ପଢୁଛନ୍ତି।"),
    ("tam", "புத்தகம் மேசையின் மீது உள்ளது, குழந்தைகள் படிக்கிறார்கள்."),
    ("tel", "పుస్తకం బల్ల మీద ఉంది, పిల్లలు చదువుతున్నారు."),
    ("kan", "ಪುಸ್ತಕ ಮೇಜಿನ ಮೇಲೆ ಇದೆ, ಮಕ್ಕಳು ಓದುತ್ತಿದ್ದಾರೆ."),
    ("mal", "പുസ്തകം മേശപ്പുറത്തുണ്ട്, കുട്ടികൾ വായിക്കുന്നു."),
    ("urd", "کتاب میز پر ہے اور بچے پڑھ رہے ہیں۔"),
    ("eng", "The book is on the table and the children are reading."),
    ("mix", "यह report कल ready होगी"),
    ("fr", "L'été à Orléans, ça dure 3 mois !"),
    ("empty", ""),
    ("punct", "?! .. 42 ;;"),
    ("url", "see https://a.b/c?d=é&x।y end"),
    ("zero", "a​b‍­﻿c"),
    ("runs", "a?!.. b,, क।।"),
    ("html", "<p>http://x.y</p> t"),
    ("digits", "१२३ ৪৫ ௬௭ ۴"),
    ("case", "ÀÖØÞ AZ É"),
    ("nfc", "café"),
    ("emoji", "x😀y"),
    ("square", "x²"),
    ("spaces", "a\u001cb c"),
    ("edge", "ॿॿॿॿ"),
    ("prefix", "... नमः hello"),
    ("bidi", "کتاب the word میز"),
]

#: Characters with the scripts that their Unicode names say.
CHARACTERS = [
    ("अ", "Devanagari"), ("ক", "Bengali"), ("ਅ", "Gurmukhi"), ("અ", "Gujarati"), ("ଅ", "Oriya"), ("அ", "Tamil"), ("అ", "Telugu"), ("ಅ", "Kannada"), ("അ", "Malayalam"), ("ا", "Arabic"), ("a", "Latin"), ("é", "Latin"),
    ("я", "Cyrillic"), ("中", "CJK"), ("7", "Digit"), ("α", "Greek"), ("ꣲ", "Devanagari"), ("ﷺ", "Arabic"),
]


def frame(spark: SparkSession) -> DataFrame:
    """The rows as a local relation; from a plain list, Python workers on the executors would read them."""
    ids, texts = zip(*TEXTS, strict=True)
    return spark.createDataFrame(pa.table({"id": ids, "text": texts}))


def values() -> str:
    """A SQL table expression with the same rows."""
    rows = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in TEXTS)
    return f"(SELECT * FROM (VALUES {rows}) v(id, text))"
