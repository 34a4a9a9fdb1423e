"""Rule-based language identification from the shares of scripts among a text's letters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptora.functions.classes import LETTER, span

#: Ranges of distinctive characters, ends inclusive; each leaves out the last code point of its block.
RANGES = {
    "tel": [(0x0C00, 0x0C7E)], "kan": [(0x0C80, 0x0CFE)], "mal": [(0x0D00, 0x0D7E)], "tam": [(0x0B80, 0x0BFE)], "ori": [(0x0B00, 0x0B7E)],
    "pan": [(0x0A00, 0x0A7E)], "guj": [(0x0A80, 0x0AFE)], "ben": [(0x0980, 0x09FE)], "urd": [(0x0600, 0x06FE), (0xFB50, 0xFDFE)],
}
DEVANAGARI, ASCII = [(0x0900, 0x097E)], [(0x41, 0x5A), (0x61, 0x7A)]


def identify(df: DataFrame, text: str = "text") -> DataFrame:
    """df with rule_lang (null where the rules don't say) and rule_confidence.

    Counts are staged: letters once, one count a range, then the rules; one
    long CASE over regular expressions would evaluate them again and again.
    The answer comes out of a one-element array, through which the optimizer
    pushes no later filter or expression back into the stages.
    """
    staged = df.withColumn("_a", F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"[^{LETTER}]+", ""))
    every = {**RANGES, "_dev": DEVANAGARI, "_asc": ASCII}
    staged = staged.withColumns({f"_n_{k}": F.length(F.regexp_replace("_a", f"[^{''.join(span(lo, hi) for lo, hi in v)}]+", "")) for k, v in every.items()} | {"_n": F.length("_a")})
    lang, conf = F.lit(None).cast("string"), F.lit(0.0)
    share = lambda k: F.col(f"_n_{k}") / F.col("_n")
    rules = [(share("_asc") > 0.85, "eng", F.lit(0.90)), (share("_dev") > 0.75, "hin", F.lit(0.55))] + [(share(k) > 0.75, k, F.least(F.lit(0.98), 0.7 + 0.28 * share(k))) for k in reversed(RANGES)]
    for when, code, value in rules:
        lang, conf = F.when((F.col("_n") > 0) & when, F.lit(code)).otherwise(lang), F.when((F.col("_n") > 0) & when, value).otherwise(conf)
    answer = F.explode(F.array(F.struct(lang.alias("lang"), conf.alias("conf"))))
    return staged.select(*df.columns, answer.alias("_r")).select(*df.columns, F.col("_r.lang").alias("rule_lang"), F.col("_r.conf").alias("rule_confidence"))


def with_fallback(df: DataFrame) -> DataFrame:
    """What a service answers without a model: English at 0.5 where the rules don't say."""
    return df.withColumn("rule_confidence", F.when(F.col("rule_lang").isNull(), 0.5).otherwise(F.col("rule_confidence"))).withColumn("rule_lang", F.coalesce("rule_lang", F.lit("eng")))
