"""Script analysis of a text: blocks, mixing, segments, direction, noise, hints, transliteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptora.functions import characters as C
from scriptora.functions import classes as K

LINK = rf"https?://[^{K.SPACE}]+|www\.[^{K.SPACE}]+"
#: Languages that a block suggests. Basic Latin suggests none.
HINTS = {
    "Devanagari": ["hin", "mar"], "Bengali": ["ben"], "Gurmukhi": ["pan"], "Gujarati": ["guj"], "Oriya": ["ori"], "Tamil": ["tam"],
    "Telugu": ["tel"], "Kannada": ["kan"], "Malayalam": ["mal"], "Arabic": ["urd"], "Latin": ["eng"],
}
#: Romanised words of Hindi, Tamil and Marathi.
ROMAN_WORDS = [
    "hai|hain|nahin|nahi|aur|yeh|woh|kya|kaun|kahan|kyun|mera|tera|apna",
    "amma|appa|anna|akka|vanakkam|nandri|romba|paaru|paar",
    "ahe|aahe|nahi|tumhi|amhi|tya|tyanche|mhanje",
]
ASPIRATES, RETROFLEX, NASALS = "kh|gh|ch|jh|th|dh|ph|bh", "[ṭḍṇṣ]", "ng|ny|ñ|ṅ"
#: The public fields of an analysis, in order.
PUBLIC = [
    "total_chars", "alpha_chars", "dominant_script", "dominant_script_ratio", "is_mixed_script", "mixing_score", "script_distribution", "script_transitions",
    "primary_direction", "has_bidi", "noise_score", "char_entropy", "unicode_blocks", "lang_hints",
]


#: Runs are placed in chunks of so many: arrays grow within a chunk and over the chunks, not over all runs of a text.
CHUNK = 64
PLACED = "array<struct<start:int,end:int,text:string>>"


def _runs(text: Column) -> tuple[Column, Column]:
    """Code points before a text's first letter, and its maximal runs of one block from there."""
    text = F.coalesce(text, F.lit(""))
    body = F.regexp_replace(text, rf"^[^{K.LETTER}]+", "")
    return F.length(text) - F.length(body), F.regexp_extract_all(body, F.lit(K.segment_pattern()), 0)


def _long_enough(run: Column) -> Column:
    return F.length(F.regexp_replace(run, rf"[^{K.LETTER}]+", "")) >= 3


def _placed(runs: Column, begin: Column) -> Column:
    """array<struct<start,end,text>> of runs that follow one another from begin on."""
    nothing = F.struct(begin.alias("at"), F.array().cast(PLACED).alias("out"))
    return F.aggregate(
        runs, nothing,
        lambda a, r: F.struct((a["at"] + F.length(r)).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(r)).alias("end"), r.alias("text")))).alias("out")),
    )["out"]


def segments(text: Column) -> Column:
    """array<struct<script,start,end,text,char_count>>: maximal runs of one block, with at least three letters.

    Offsets are code points, ends exclusive; what is not a letter belongs to
    the run before it, and what comes before the first letter to none.
    """
    begin, runs = _runs(text)
    last = lambda r: F.greatest(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int"))
    chunks = C.bound(runs, lambda r: F.transform(F.sequence(F.lit(0), last(r)), lambda k: F.slice(r, k * CHUNK + 1, F.lit(CHUNK))))
    chars = lambda chunk: F.aggregate(chunk, F.lit(0), lambda n, r: n + F.length(r))
    starts = lambda every: F.aggregate(every, F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, c: F.struct((a["at"] + chars(c)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    placed = C.bound(chunks, lambda every: F.flatten(F.zip_with(every, starts(every), _placed)))
    kept = F.filter(placed, lambda x: _long_enough(x["text"]))
    return F.transform(kept, lambda x: F.struct(C.block_of(F.substring(x["text"], 1, 1)).alias("script"), x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.length(x["text"]).alias("char_count")))


def segment_count(text: Column) -> Column:
    """The number of segments, without placing them."""
    return F.size(F.filter(_runs(text)[1], _long_enough))


def mixing_score(shares: Column) -> Column:
    """Entropy of the shares over its largest value; 0 for one script or none."""
    h = F.aggregate(F.map_values(shares), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    return F.when(F.size(shares) > 1, h / F.log2(F.size(shares).cast("double"))).otherwise(0.0)


def noise_score(links: Column, zero_width: Column, control: Column, punctuation: Column, emoji: Column) -> Column:
    return 0.3 * F.least(F.lit(1.0), links * 0.5) + 0.2 * zero_width.cast("int") + 0.2 * control.cast("int") + 0.15 * punctuation.cast("int") + 0.15 * F.least(F.lit(1.0), emoji * 0.2)


def analyze(df: DataFrame, text: str = "text") -> DataFrame:
    """df with every field of the analysis of its texts as columns. Null and empty texts have zeros and the script Unknown."""
    staged = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_chars", C.tally(F.col("_t")))
    chars, n = F.col("_chars"), F.col("total_chars")
    staged = staged.withColumns({
        "_blocks": C.summed(C.by_name(chars, C.block_of, C.is_letter)), "_every": C.summed(C.by_name(chars, C.block_name)), "total_chars": F.length("_t").cast("long"), "alpha_chars": C.total(chars, C.is_letter),
        "digit_chars": C.total(chars, C.is_digit), "punct_chars": C.total(chars, C.is_punctuation), "space_chars": C.total(chars, C.is_space), "char_entropy": C.entropy(chars), "unique_chars": F.size("_chars").cast("long"),
        "script_segments": segments(F.col("_t")), "url_count": F.regexp_count("_t", F.lit(LINK)).cast("long"), "emoji_count": F.regexp_count("_t", F.lit(K.EMOJI)).cast("long"),
        "has_zero_width": F.col("_t").rlike(K.ZERO_WIDTH), "has_control_chars": F.col("_t").rlike(K.CONTROL),
    })
    staged = staged.withColumns({
        "other_chars": n - F.col("alpha_chars") - F.col("digit_chars") - F.col("punct_chars") - F.col("space_chars"), "script_distribution": C.shares(F.col("_blocks")), "dominant_script": C.largest(F.col("_blocks")),
        "script_transitions": F.greatest(F.lit(0), segment_count(F.col("_t")) - 1).cast("long"), "has_excessive_punct": F.col("punct_chars") / F.greatest(n, F.lit(1)) > 0.15,
        "_ranked": F.slice(F.array_sort(F.transform("_every", lambda x, k: F.struct((-x["n"]).alias("n"), k.alias("at"), x["k"].alias("k")))), 1, 10),
        "rtl_ratio": F.aggregate(F.filter("_blocks", lambda x: x["k"].isin("Arabic", "Hebrew")), F.lit(0).cast("long"), lambda a, x: a + x["n"]) / F.greatest(F.col("alpha_chars"), F.lit(1)),
    })
    shares = F.col("script_distribution")
    hints = F.create_map(*[y for k, v in HINTS.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    staged = staged.withColumns({
        "dominant_script_ratio": C.map_max(shares), "mixing_score": mixing_score(shares), "primary_direction": F.when(F.col("rtl_ratio") > 0.5, "RTL").otherwise("LTR"),
        "has_bidi": (F.col("rtl_ratio") > 0.05) & (F.col("rtl_ratio") < 0.95), "latin_ratio": F.coalesce(shares["Basic Latin"], F.lit(0.0)) + F.coalesce(shares["Latin"], F.lit(0.0)),
        "noise_score": noise_score(F.col("url_count"), F.col("has_zero_width"), F.col("has_control_chars"), F.col("has_excessive_punct"), F.col("emoji_count")),
        "unicode_blocks": F.map_from_entries(F.transform("_ranked", lambda x: F.struct(x["k"], -x["n"].cast("double") / n))),
        "lang_hints": F.map_from_entries(F.transform(F.map_keys(shares), lambda k: F.struct(k, F.coalesce(hints[k], F.array().cast("array<string>"))))),
    })
    return staged.withColumn("is_mixed_script", (F.size("script_distribution") > 1) & (F.col("dominant_script_ratio") < 0.95)).drop("_t", "_chars", "_blocks", "_every", "_ranked")


def compare(df: DataFrame, first: str, second: str) -> DataFrame:
    """df with shared blocks, their Jaccard index, dominant scripts and mixing scores of two text columns."""
    out = df
    for k, name in enumerate((first, second), 1):
        out = out.withColumn(f"_b{k}", C.summed(C.by_name(C.tally(F.col(name)), C.block_of, C.is_letter))).withColumn(f"_s{k}", C.shares(F.col(f"_b{k}")))
    a, b = F.map_keys("_s1"), F.map_keys("_s2")
    out = out.withColumns({
        "shared_scripts": F.array_sort(F.array_intersect(a, b)), "script_jaccard": F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))),
        "text1_dominant": C.largest(F.col("_b1")), "text2_dominant": C.largest(F.col("_b2")), "text1_mixing_score": mixing_score(F.col("_s1")), "text2_mixing_score": mixing_score(F.col("_s2")),
    })
    return out.drop("_b1", "_b2", "_s1", "_s2")


def transliteration(df: DataFrame, text: str = "text") -> DataFrame:
    """df with is_transliteration, its confidence and the five pieces of evidence."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.lit(False)
    for group in ROMAN_WORDS:
        words = words | t.rlike(rf"(?iuU)\b({group})\b")
    out = df.withColumn("_b", C.summed(C.by_name(C.tally(t), C.block_of, C.is_letter))).withColumns({
        "latin_dominated": C.largest(F.col("_b")).isin("Basic Latin", "Latin Extended-A"), "has_indic_patterns": words, "has_aspirates": t.rlike(f"(?iu)({ASPIRATES})"), "has_retroflex": t.rlike(RETROFLEX), "has_nasal_markers": t.rlike(f"(?iu)({NASALS})"),
    })
    likely = F.col("latin_dominated") & (F.col("has_indic_patterns") | F.col("has_aspirates"))
    return out.withColumn("is_transliteration", likely).withColumn("confidence", F.when(likely & F.col("has_aspirates"), 0.8).otherwise(0.5)).drop("_b")
