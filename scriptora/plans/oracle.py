"""DuckDB SQL for the queries: the same results by other means."""

from __future__ import annotations

from scriptora.functions import classes as K
from scriptora.functions import cleaning
from scriptora.functions import registry as R
from scriptora.operators import ensemble, heuristic, scripts
from scriptora.plans import fixture

W, L, P, D = K.SPACE, K.LETTER, K.PUNCTUATION, K.DIGIT


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def case_of(column: str, field: int, otherwise: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(r[0])} THEN {q(r[field])}" for r in R.LANGUAGES) + f" ELSE {otherwise} END"


CORPUS_CODE = "CASE lang " + " ".join(f"WHEN {q(r[3])} THEN {q(r[0])}" for r in R.LANGUAGES) + " ELSE lang END"
DOCS = f"(SELECT doc_id, {CORPUS_CODE} AS lang, text FROM documents)"
FIXTURE = fixture.values()


def preprocess(t: str, nfc: bool = False) -> str:
    t = f"coalesce({t}, '')"
    t = f"nfc_normalize({t})" if nfc else t
    # RE2's word boundary is ASCII, so the boundaries of an address are spelled out.
    email = r"(^|[^\p{L}\p{N}_\p{Mn}])[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
    for pattern, to in ((K.ZERO_WIDTH, ""), ("<[^>]+>", " "), (cleaning.URL, " "), (email, r"\1 ")):
        t = f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"
    t = f"translate({t}, {q(cleaning.INDIC_DIGITS)}, {q('0123456789' * 9)})"
    t = f"regexp_replace({t}, {q(cleaning.PUNCTUATION_RUN)}, '\\1', 'g')"
    return f"left(trim(regexp_replace({t}, {q(f'[{W}]+')}, ' ', 'g'), ' '), 2000)"


def count(t: str, cls: str) -> str:
    return f"CAST(length(regexp_replace({t}, {q(f'[^{cls}]+')}, '', 'g')) AS BIGINT)"


BARE = f"regexp_replace(coalesce(text, ''), {q(f'^[{W}]+|[{W}]+$')}, '', 'g')"
GATED = f"(SELECT doc_id, lang, left(text, 2000) AS text, CAST(length(text) AS BIGINT) AS text_len FROM {DOCS} WHERE length({BARE}) >= 50 AND length(regexp_replace({BARE}, {q(f'[^{L}]+')}, '', 'g')) / greatest(length({BARE}), 1) >= 0.4)"


def chars(source: str, key: str) -> str:
    """CTEs: t (key, text), ch (key, c, n, first), one row a different character."""
    return f"""t AS (SELECT {key} AS key, coalesce(text, '') AS text FROM {source}),
one AS (SELECT key, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS pos FROM t WHERE text <> ''),
ch AS (SELECT key, c, count(*) AS n, min(pos) AS first FROM one GROUP BY key, c)"""


ENTROPY = "ent AS (SELECT key, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h, count(*) AS u FROM ch GROUP BY key)"


def shares(name: str, fallback: str, only_letters: bool) -> str:
    """CTEs: sc (key, k, n, first) and dist (key, d, top, most, kinds): counts by name, and their shares."""
    letters = f"WHERE regexp_full_match(c, {q(f'[{L}]')})" if only_letters else ""
    return f"""sc AS (SELECT key, coalesce({name}, {fallback}) AS k, sum(n) AS n, min(first) AS first FROM ch {letters} GROUP BY 1, 2),
dist AS (SELECT key, string_agg(k || '=' || CAST(floor(n / total * 1e6 + 1e-3) AS BIGINT), ';' ORDER BY k) AS d, arg_max(k, (n, -first)) AS top, max(n / total) AS most, count(*) AS kinds,
  CASE WHEN count(*) > 1 THEN -sum(n / total * log2(n / total)) / log2(count(*)) ELSE 0.0 END AS mixing, coalesce(max(CASE WHEN k = 'Arabic' THEN n / total END), 0.0) AS rtl, coalesce(max(CASE WHEN k = 'Basic Latin' THEN n / total END), 0.0) AS latin
  FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS total FROM sc) GROUP BY key)"""


QUALITY = "CASE WHEN length(text) > 0 THEN 0.3 * (a / greatest(length(text), 1)) + 0.4 * coalesce(most, 0.0) + 0.3 * least(1.0, length(text) / 100.0) ELSE 0.0 END"


def features(source: str, key: str, out: str) -> str:
    return f"""WITH {chars(source, key)}, {ENTROPY}, {shares(K.script_case('unicode(c)'), "'Other'", True)},
f AS (SELECT t.key, text, {count('text', L)} AS a, {count('text', D)} AS dg, {count('text', P)} AS p, {count('text', W)} AS s, ent.h, ent.u, dist.*,
  list_filter(regexp_split_to_array(text, {q(f'[{W}]+')}), lambda w: w <> '') AS words FROM t LEFT JOIN ent ON ent.key = t.key LEFT JOIN dist ON dist.key = t.key)
SELECT {out} FROM f"""


def analysis(source: str, key: str) -> str:
    return f"""WITH {chars(source, key)}, {ENTROPY}, {shares(K.block_case('unicode(c)'), "'Unknown'", True)},
runs AS (SELECT key, len(list_filter(regexp_extract_all(regexp_replace(text, {q(f'^[^{L}]+')}, ''), {q(K.segment_pattern(False))}), lambda r: length(regexp_replace(r, {q(f'[^{L}]+')}, '', 'g')) >= 3)) AS kept FROM t),
f AS (SELECT t.key AS id, text, CAST(length(text) AS BIGINT) AS n, {count('text', L)} AS a, {count('text', D)} AS dg, {count('text', P)} AS p, {count('text', W)} AS s, coalesce(ent.h, 0.0) AS h, dist.*, runs.kept,
  CAST(len(regexp_extract_all(text, {q(scripts.LINK)})) AS BIGINT) AS links, CAST(len(regexp_extract_all(text, {q(K.EMOJI)})) AS BIGINT) AS emoji, regexp_matches(text, {q(K.ZERO_WIDTH)}) AS zw, regexp_matches(text, {q(K.CONTROL)}) AS ctrl
  FROM t LEFT JOIN ent ON ent.key = t.key LEFT JOIN dist ON dist.key = t.key LEFT JOIN runs ON runs.key = t.key)
SELECT id AS {key}, n AS total_chars, a AS alpha_chars, dg AS digit_chars, p AS punct_chars, s AS space_chars, n - a - dg - p - s AS other_chars, coalesce(top, 'Unknown') AS dominant_script, coalesce(kinds > 1 AND most < 0.95, false) AS is_mixed_script,
  CAST(greatest(0, kept - 1) AS BIGINT) AS script_transitions, CASE WHEN coalesce(rtl, 0) > 0.5 THEN 'RTL' ELSE 'LTR' END AS primary_direction, coalesce(rtl, 0) > 0.05 AND coalesce(rtl, 0) < 0.95 AS has_bidi, zw AS has_zero_width, ctrl AS has_control_chars,
  p / greatest(n, 1) > 0.15 AS has_excessive_punct, links AS url_count, emoji AS emoji_count, coalesce(d, '') AS script_distribution, round(coalesce(most, 0.0), 6) AS dominant_script_ratio, round(coalesce(mixing, 0.0), 6) AS mixing_score, round(coalesce(rtl, 0.0), 6) AS rtl_ratio,
  round(coalesce(latin, 0.0), 6) AS latin_ratio, round(CAST(0.3 * least(1.0, links * 0.5) + 0.2 * CAST(zw AS INT) + 0.2 * CAST(ctrl AS INT) + 0.15 * CAST(p / greatest(n, 1) > 0.15 AS INT) + 0.15 * least(1.0, emoji * 0.2) AS DOUBLE), 6) AS noise_score, round(h, 6) AS char_entropy FROM f"""


def rules(source: str, keep: str) -> str:
    """Subquery with rule_lang and rule_confidence."""
    ranges = {**heuristic.RANGES, "dev": heuristic.DEVANAGARI, "asc": heuristic.ASCII}
    counts = ", ".join(f"length(regexp_replace(letters, {q('[^' + ''.join(K.span(lo, hi) for lo, hi in v) + ']+')}, '', 'g')) / nullif(length(letters), 0) AS r_{k}" for k, v in ranges.items())
    lang = "CASE " + " ".join(f"WHEN r_{k} > 0.75 THEN '{k}'" for k in heuristic.RANGES) + " WHEN r_dev > 0.75 THEN 'hin' WHEN r_asc > 0.85 THEN 'eng' END"
    conf = "CASE " + " ".join(f"WHEN r_{k} > 0.75 THEN least(0.98, 0.7 + 0.28 * r_{k})" for k in heuristic.RANGES) + " WHEN r_dev > 0.75 THEN 0.55 WHEN r_asc > 0.85 THEN 0.90 ELSE 0.0 END"
    return f"(SELECT {keep}, {lang} AS rule_lang, CAST({conf} AS DOUBLE) AS rule_confidence FROM (SELECT *, {counts} FROM (SELECT *, regexp_replace(coalesce(text, ''), {q(f'[^{L}]+')}, '', 'g') AS letters FROM {source})))"


JUDGED = f"(SELECT doc_id, text, lang AS \"true\", coalesce(rule_lang, '') AS pred, rule_confidence AS confidence, lang = coalesce(rule_lang, '') AS correct FROM {rules(DOCS, 'doc_id, text, lang')})"
CONFUSION = f'(SELECT "true", pred, count(*) AS n FROM {JUDGED} GROUP BY 1, 2)'
CLASSES = f"""(SELECT class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS "precision", CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
  CASE WHEN predicted + support > 0 THEN 2.0::DOUBLE * tp / (predicted + support) ELSE 0.0 END AS f1, support FROM (
  SELECT class, CAST(coalesce(sum(n) FILTER (WHERE side = 't'), 0) AS BIGINT) AS support, CAST(coalesce(sum(n) FILTER (WHERE side = 'p'), 0) AS BIGINT) AS predicted, CAST(coalesce(sum(n) FILTER (WHERE side = 't' AND hit), 0) AS BIGINT) AS tp
  FROM (SELECT "true" AS class, 't' AS side, "true" = pred AS hit, n FROM {CONFUSION} UNION ALL SELECT pred, 'p', false, n FROM {CONFUSION}) GROUP BY class))"""
BINNED = f"(SELECT *, CASE WHEN confidence < 1 THEN CAST(floor(confidence * 15 + 1e-12) AS BIGINT) END AS bin FROM {JUDGED})"
TEXTS = f"(SELECT lang, text FROM {DOCS} WHERE text <> '')"


def raw(docs: str = TEXTS) -> str:
    return f"(SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(regexp_split_to_array(text, {q(f'[{W}]+')})) AS token FROM {docs}) WHERE token <> '' GROUP BY 1, 2)"


def words_of(docs: str = TEXTS) -> str:
    return f"(SELECT lang, trim(token, {q(K.WORD_EDGE)}) AS token, CAST(sum(n) AS BIGINT) AS n FROM {raw(docs)} WHERE length(trim(token, {q(K.WORD_EDGE)})) >= 2 GROUP BY 1, 2)"


def letters_of(docs: str = TEXTS) -> str:
    return f"(SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS token FROM {docs}) WHERE regexp_full_match(token, {q(f'[{L}]')}) GROUP BY 1, 2)"


def grams(k: int) -> str:
    return f"(SELECT lang, substring(token, i, {k}) AS token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT lang, token, n, unnest(range(1, length(token) - {k - 2})) AS i FROM {raw()} WHERE length(token) >= {k}) GROUP BY 1, 2)"


def top(counts: str, k: int) -> str:
    return f"SELECT lang, token, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rank FROM {counts}) WHERE rank <= {k}"


def profile(source: str) -> str:
    words, letters = words_of(source), letters_of(source)
    return f"""WITH t AS (SELECT lang, count(*) AS n_documents, avg(length(text)) AS mean, median(length(text)) AS med FROM {source} GROUP BY lang),
c AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total_chars, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM {letters} GROUP BY lang),
w AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total_words, count(*) AS vocab_size, count(*) FILTER (WHERE n = 1) AS hapax, sum(length(token) * n) / sum(n) AS wl FROM {words} GROUP BY lang)
SELECT t.lang, {case_of('t.lang', 1, 't.lang')} AS name, {case_of('t.lang', 2, "'?'")} AS script, n_documents, coalesce(total_chars, 0) AS total_chars, coalesce(total_words, 0) AS total_words, coalesce(vocab_size, 0) AS vocab_size,
  round(coalesce(vocab_size, 0) / greatest(coalesce(total_words, 0), 1), 4) AS ttr, round(coalesce(hapax, 0) / greatest(coalesce(vocab_size, 0), 1), 4) AS hapax_ratio, round(coalesce(h, 0.0), 4) AS char_entropy, round(mean, 1) AS avg_text_len, round(coalesce(wl, 0.0), 2) AS avg_word_len, round(med, 1) AS median_text_len
FROM t LEFT JOIN c ON c.lang = t.lang LEFT JOIN w ON w.lang = t.lang"""


SIMILARITY = f"""(WITH g AS {grams(2)}, norm AS (SELECT lang, sqrt(sum(CAST(n AS DOUBLE) * n)) AS z FROM g GROUP BY lang),
dot AS (SELECT a.lang AS lang1, b.lang AS lang2, sum(CAST(a.n AS DOUBLE) * b.n) AS d FROM g a JOIN g b USING (token) GROUP BY 1, 2)
SELECT x.lang AS lang1, y.lang AS lang2, coalesce(d / (x.z * y.z), 0.0) AS sim FROM norm x CROSS JOIN norm y LEFT JOIN dot ON dot.lang1 = x.lang AND dot.lang2 = y.lang)"""


def votes(source: str, keep: str) -> str:
    """Prediction without a learned model: the rules' blend, the first language where they are silent, and the markers."""
    present = lambda markers: " + ".join(f"CAST(contains(text, {q(m)}) AS INT)" for m in markers)
    return f"""(SELECT *, CASE WHEN short THEN rule_lang WHEN deva AND mar > hin + 1 THEN 'mar' WHEN deva AND hin > mar + 1 THEN 'hin' ELSE base END AS predicted_lang,
  round(CAST(CASE WHEN short THEN rule_confidence WHEN deva AND mar > hin + 1 THEN least(0.95, conf + 0.1 * mar) WHEN deva AND hin > mar + 1 THEN least(0.95, conf + 0.05 * hin) ELSE conf END AS DOUBLE), 4) AS confidence, CASE WHEN short THEN 'heuristic' ELSE 'ensemble' END AS source
FROM (SELECT *, coalesce(rule_lang, 'ben') AS base, CASE WHEN rule_lang IS NULL THEN 0.0 ELSE 0.3 * rule_confidence END AS conf, coalesce(rule_lang IN ('hin', 'mar'), false) AS deva, coalesce(rule_confidence >= 0.92 AND rule_lang NOT IN ('hin', 'mar'), false) AS short, {present(ensemble.MARATHI)} AS mar, {present(ensemble.HINDI)} AS hin
FROM {rules(source, keep + ', text')}))"""


def translit() -> str:
    words = " OR ".join(f"regexp_matches(text, {q(f'(?i)(^|[^\\p{{L}}\\p{{N}}_])({g})($|[^\\p{{L}}\\p{{N}}_])')})" for g in scripts.ROMAN_WORDS)
    return f"""WITH {chars("(SELECT conv_id || '/' || turn AS key, text FROM conversations)", 'key')}, {shares(K.block_case('unicode(c)'), "'Unknown'", True)},
e AS (SELECT conv_id, turn, coalesce(dist.top IN ('Basic Latin', 'Latin Extended-A'), false) AS latin_dominated, {words} AS has_indic_patterns, regexp_matches(text, '(?i)({scripts.ASPIRATES})') AS has_aspirates, regexp_matches(text, '{scripts.RETROFLEX}') AS has_retroflex, regexp_matches(text, '(?i)({scripts.NASALS})') AS has_nasal_markers
  FROM (SELECT conv_id, turn, conv_id || '/' || turn AS key, coalesce(text, '') AS text FROM conversations) x LEFT JOIN dist USING (key))
SELECT conv_id, turn, latin_dominated AND (has_indic_patterns OR has_aspirates) AS is_transliteration, CAST(CASE WHEN latin_dominated AND has_aspirates THEN 0.8 ELSE 0.5 END AS DOUBLE) AS confidence, latin_dominated, has_indic_patterns, has_aspirates, has_retroflex, has_nasal_markers FROM e"""


COMPARE = f"""WITH {chars("(SELECT conv_id || '/' || turn AS key, text FROM conversations)", 'key')}, {shares(K.block_case('unicode(c)'), "'Unknown'", True)},
s AS (SELECT conv_id, turn, coalesce(ks, []) AS ks, coalesce(top, 'Unknown') AS top, coalesce(mixing, 0.0) AS mixing FROM (SELECT conv_id, turn, conv_id || '/' || turn AS key FROM conversations) LEFT JOIN dist USING (key) LEFT JOIN (SELECT key, list(k) AS ks FROM sc GROUP BY key) USING (key))
SELECT a.conv_id, a.turn, array_to_string(list_sort(list_intersect(a.ks, b.ks)), ',') AS shared_scripts, round(len(list_intersect(a.ks, b.ks)) / greatest(1, len(list_distinct(list_concat(a.ks, b.ks)))), 6) AS script_jaccard,
  round(a.mixing, 6) AS text1_mixing_score, round(b.mixing, 6) AS text2_mixing_score, a.top AS text1_dominant, b.top AS text2_dominant FROM s a JOIN s b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn"""

SEGMENTS = f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT id, text FROM {FIXTURE}),
b AS (SELECT id, length(text) - length(regexp_replace(text, {q(f'^[^{L}]+')}, '')) AS begin, regexp_extract_all(regexp_replace(text, {q(f'^[^{L}]+')}, ''), {q(K.segment_pattern(False))}) AS runs FROM t),
r AS (SELECT id, begin, unnest(runs) AS segment, generate_subscripts(runs, 1) AS i FROM b),
p AS (SELECT id, segment, i, begin + sum(length(segment)) OVER (PARTITION BY id ORDER BY i) AS end_at FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM p WHERE length(regexp_replace(segment, {q(f'[^{L}]+')}, '', 'g')) >= 3)
SELECT id, pos, coalesce({K.block_case('unicode(segment)')}, 'Unknown') AS script, CAST(end_at - length(segment) AS BIGINT) AS start_at, CAST(end_at AS BIGINT) AS end_at, segment FROM k"""

#: Stated here once more, apart from the code that they check.
CODES = ["ben", "eng", "guj", "hin", "kan", "mal", "mar", "ori", "pan", "tam", "tel", "urd"]
HINTS = "CASE k WHEN 'Devanagari' THEN 'hin,mar' WHEN 'Bengali' THEN 'ben' WHEN 'Gurmukhi' THEN 'pan' WHEN 'Gujarati' THEN 'guj' WHEN 'Oriya' THEN 'ori' WHEN 'Tamil' THEN 'tam' WHEN 'Telugu' THEN 'tel' WHEN 'Kannada' THEN 'kan' WHEN 'Malayalam' THEN 'mal' WHEN 'Arabic' THEN 'urd' WHEN 'Latin' THEN 'eng' ELSE '' END"
SPANS = {
    "ben": [(2432, 2559)], "eng": [(0, 127), (128, 255), (256, 383)], "guj": [(2688, 2815)], "hin": [(2304, 2431), (43232, 43263)], "kan": [(3200, 3327)], "mal": [(3328, 3455)],
    "mar": [(2304, 2431), (43232, 43263)], "ori": [(2816, 2943)], "pan": [(2560, 2687)], "tam": [(2944, 3071)], "tel": [(3072, 3199)], "urd": [(1536, 1791), (1872, 1919), (64336, 65023), (65136, 65279)],
}
INSIDE = " ".join(f"WHEN '{code}' THEN {' OR '.join(f'unicode(c) BETWEEN {lo} AND {hi}' for lo, hi in spans)}" for code, spans in SPANS.items())
EXPECTED = "SELECT {} FROM (SELECT unnest(['ben', 'eng', 'guj', 'hin', 'kan', 'mal', 'mar', 'ori', 'pan', 'tam', 'tel', 'urd']) AS code)"

SEEDED = "md5('42:' || doc_id)"
FEATURES = (
    "key AS doc_id, CAST(length(text) AS BIGINT) AS n_chars, a AS n_alpha, dg AS n_digits, p AS n_punct, s AS n_spaces, coalesce(top, 'Unknown') AS dominant_script, coalesce(d, '') AS script_distribution, CAST(coalesce(kinds, 0) AS BIGINT) AS script_count,"
    " coalesce(kinds > 1 AND most < 0.95, false) AS is_mixed_script, CAST(len(words) AS BIGINT) AS n_words, round(a / greatest(length(text), 1), 6) AS alpha_ratio, round(dg / greatest(length(text), 1), 6) AS digit_ratio, round(coalesce(u, 0) / greatest(length(text), 1), 6) AS unique_char_ratio,"
    f" round(CAST({QUALITY} AS DOUBLE), 6) AS quality_score, round(coalesce(list_avg(list_transform(words, lambda w: length(w))), 0.0), 6) AS avg_word_len, round(coalesce(h, 0.0), 6) AS char_entropy"
)

ORACLE_SQL: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {preprocess('text')} AS clean FROM documents",
    "strip_html": f"SELECT page_id, {preprocess('html')} AS clean FROM pages",
    "nfc_clean": f"SELECT id, {preprocess('text', True)} AS clean FROM {FIXTURE}",
    "lower_latin": f"SELECT id, translate(text, {q(cleaning.UPPER)}, {q(cleaning.UPPER.lower())}) AS lowered, left(text, 10) || CASE WHEN length(text) > 10 THEN '...' ELSE '' END AS preview FROM {FIXTURE}",
    "fasttext_lines": f"SELECT '__label__' || lang || ' ' || trim(regexp_replace(coalesce(text, ''), {q(f'[{W}]+')}, ' ', 'g'), ' ') AS line FROM {DOCS}",
    "quality_gate": f"SELECT doc_id, lang, text, text_len FROM {GATED}",
    "post_clean_filter": f"SELECT doc_id, CAST(length({preprocess('text')}) AS BIGINT) AS clean_len FROM documents WHERE length({preprocess('text')}) >= 30",
    "dataset_stats": f"SELECT lang, {case_of('lang', 1, 'lang')} AS name, {case_of('lang', 2, q('?'))} AS script, count(*) AS n_samples, round(avg(text_len), 6) AS avg_len, CAST(min(length(text)) AS BIGINT) AS min_len, CAST(max(length(text)) AS BIGINT) AS max_len, count(DISTINCT doc_id) AS unique_docs FROM {GATED} GROUP BY lang",
    "balanced_sample": f"SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) AS r, (SELECT min(c) FROM (SELECT count(*) AS c FROM {DOCS} GROUP BY lang)) AS m FROM {DOCS}) WHERE r <= m",
    "stratified_split": f"SELECT doc_id, lang, CASE WHEN r <= t THEN 'test' WHEN r <= t + round((c - t) * (0.05::DOUBLE / (1 - 0.1::DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM (SELECT *, round(c * 0.1::DOUBLE) AS t FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {SEEDED}, doc_id) AS r, count(*) OVER (PARTITION BY lang) AS c FROM {DOCS}))",
    "registry_rows": "SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(n)}, {q(s)}, {q(i)}, {k}, {q(d)}, {q(f)}, {len(dict(K.SCRIPTS)[s])}::BIGINT, {q(','.join(o))})" for c, n, s, i, k, d, f, _, _, o in R.LANGUAGES) + ") v(code, name, script, iso639_1, label_id, direction, family, n_ranges, shares)",
    "char_class_counts": f"SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {count('text', L)} AS n_alpha, {count('text', D)} AS n_digits, {count('text', P)} AS n_punct, {count('text', W)} AS n_spaces FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "char_entropy": f"WITH {chars('documents', 'doc_id')}, {ENTROPY} SELECT t.key AS doc_id, round(coalesce(h, 0.0), 6) AS char_entropy, coalesce(u, 0) AS unique_chars FROM t LEFT JOIN ent ON ent.key = t.key",
    "text_features": features("documents", "doc_id", FEATURES),
    "dominant_script": features(FIXTURE, "id", f"key AS id, coalesce(top, 'Unknown') AS dominant_script, coalesce(d, '') AS script_distribution, a AS n_alpha, dg AS n_digits, p AS n_punct, round(CAST({QUALITY} AS DOUBLE), 6) AS quality_score, round(coalesce(h, 0.0), 6) AS char_entropy"),
    "unicode_blocks": f"WITH {chars('documents', 'doc_id')}, sc AS (SELECT key, coalesce({K.block_case('unicode(c)')}, 'U+' || lpad(hex(unicode(c)), 4, '0') || ' (unknown block)') AS k, sum(n) AS n, min(first) AS first FROM ch GROUP BY 1, 2), ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, first) AS r FROM sc) SELECT t.key AS doc_id, coalesce(string_agg(k || '=' || CAST(floor(n / length(text) * 1e6 + 1e-3) AS BIGINT), ';' ORDER BY k), '') AS unicode_blocks FROM t LEFT JOIN ranked ON ranked.key = t.key AND r <= 10 GROUP BY 1",
    "script_analysis": analysis("documents", "doc_id"),
    "script_analysis_indic": analysis(FIXTURE, "id"),
    "script_segments": SEGMENTS,
    "transliteration": translit(),
    "compare_scripts": COMPARE,
    "heuristic_lang": f"SELECT doc_id, rule_lang, round(rule_confidence, 6) AS rule_confidence FROM {rules('documents', 'doc_id')}",
    "heuristic_indic": f"SELECT id, rule_lang, round(rule_confidence, 6) AS rule_confidence FROM {rules(FIXTURE, 'id')}",
    "heuristic_fallback": f"SELECT id, coalesce(rule_lang, 'eng') AS rule_lang, round(CASE WHEN rule_lang IS NULL THEN 0.5 ELSE rule_confidence END, 6) AS rule_confidence FROM {rules(FIXTURE, 'id')}",
    "language_by_label": f"SELECT lang, {case_of('lang', 1, 'lang')} AS name, rule_lang, count(*) AS n, round(avg(rule_confidence), 6) AS mean_confidence FROM {rules(f'(SELECT * FROM (SELECT lang, {preprocess("text")} AS text FROM {DOCS}) WHERE length(text) >= 30)', 'lang')} GROUP BY 1, 2, 3",
    "char_freq_top": top(letters_of(), 20),
    "word_freq_top": top(words_of(), 30),
    "bigram_top": top(grams(2), 20),
    "trigram_top": top(grams(3), 20),
    "profile_stats": profile(TEXTS),
    "profile_registry_only": profile(f"(SELECT * FROM {TEXTS} WHERE lang IN ({', '.join(map(q, R.CODES))}))"),
    "vocab_richness": f"SELECT lang, {case_of('lang', 1, 'lang')} AS name, v AS V_vocab, CAST(s AS BIGINT) AS N_tokens, round(v / s, 6) AS ttr, round(v / sqrt(s), 6) AS guiraud, round(CASE WHEN s > 1 THEN ln(v) / ln(s) ELSE 0.0 END, 6) AS herdan, round(10000.0::DOUBLE * (m - s) / (s * s), 6) AS yule_k FROM (SELECT lang, count(*) AS v, CAST(sum(n) AS DOUBLE) AS s, sum(CAST(n AS DOUBLE) * n) AS m FROM {words_of()} GROUP BY lang)",
    "lang_similarity": f"SELECT lang1, lang2, round(sim, 6) AS sim FROM {SIMILARITY}",
    "confusable_pairs": f"SELECT lang1, lang2, round(sim, 4) AS sim FROM {SIMILARITY} WHERE lang1 < lang2 AND sim >= 0.2",
    "confusion": f'SELECT "true", pred, n, round(n / sum(n) OVER (PARTITION BY "true"), 6) AS share FROM {CONFUSION}',
    "class_report": f'SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {CLASSES}',
    "overall_metrics": f'SELECT round((SELECT sum(n) FILTER (WHERE "true" = pred) / sum(n) FROM {CONFUSION}), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(avg("precision"), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, (SELECT CAST(sum(n) AS BIGINT) FROM {CONFUSION}) AS n_samples, (SELECT count(DISTINCT "true") FROM {CONFUSION}) AS n_classes FROM {CLASSES}',
    "calibration_error": f"SELECT round(sum(CASE WHEN bin IS NOT NULL THEN n * abs(c - a) ELSE 0 END) / sum(n), 6) AS ece, round(sum(s) / sum(n), 4) AS mean_confidence, round(sum(h) / sum(n), 4) AS high_confidence_ratio FROM (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS INT)) AS a, sum(confidence) AS s, count(*) FILTER (WHERE confidence >= 0.9) AS h FROM {BINNED} GROUP BY bin)",
    "reliability_bins": f"SELECT b.range AS bin, coalesce(n, 0) AS n, round(coalesce(c, (b.range + 0.5) / 15), 6) AS confidence, round(a, 6) AS accuracy FROM range(15) b LEFT JOIN (SELECT bin, count(*) AS n, avg(confidence) AS c, avg(CAST(correct AS INT)) AS a FROM {BINNED} WHERE bin IS NOT NULL GROUP BY bin) x ON x.bin = b.range",
    "error_summary": f'SELECT "true" AS true_lang, pred AS pred_lang, n AS count, {case_of(chr(34) + "true" + chr(34), 1, "NULL")} AS true_name, {case_of("pred", 1, "NULL")} AS pred_name FROM {CONFUSION} WHERE "true" <> pred ORDER BY n DESC, 1, 2 LIMIT 50',
    "error_rate": f'SELECT "true" AS lang, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(sum(n) FILTER (WHERE "true" <> pred), 0) AS BIGINT) AS errors, round(coalesce(sum(n) FILTER (WHERE "true" <> pred), 0) / sum(n), 6) AS error_rate FROM {CONFUSION} GROUP BY 1',
    "error_samples": f'SELECT true_lang, pred_lang, doc_id, text, rank FROM (SELECT "true" AS true_lang, pred AS pred_lang, doc_id, left(text, 200) AS text, row_number() OVER (PARTITION BY "true", pred ORDER BY doc_id) AS rank FROM {JUDGED} WHERE "true" <> pred) WHERE rank <= 5',
    "confidence_thresholds": f"WITH p AS (SELECT \"true\", pred AS lang, confidence AS p FROM {JUDGED} WHERE pred <> ''), g AS (SELECT 0.3::DOUBLE + range * (0.99::DOUBLE - 0.3::DOUBLE) / 49 AS t FROM range(50)), s AS (SELECT lang, t, avg(CAST(\"true\" = lang AS INT)) AS pr FROM p JOIN g ON p.p >= g.t GROUP BY 1, 2) SELECT l.lang, round(coalesce(min(t), 0.5), 6) AS threshold FROM (SELECT DISTINCT lang FROM p) l LEFT JOIN s ON s.lang = l.lang AND pr >= 0.6 GROUP BY 1",
    "ensemble_vote": f"SELECT doc_id, predicted_lang, {case_of('predicted_lang', 1, 'predicted_lang')} AS predicted_lang_name, {case_of('predicted_lang', 2, q('Unknown'))} AS script, {case_of('predicted_lang', 5, q('LTR'))} AS direction, confidence, confidence >= 0.75 AS is_confident, source, left(coalesce(text, ''), 80) || CASE WHEN length(text) > 80 THEN '...' ELSE '' END AS text_preview FROM {votes('documents', 'doc_id')}",
    "devanagari_disambiguation": f"SELECT id, predicted_lang, confidence, {case_of('predicted_lang', 5, q('LTR'))} AS direction, source FROM {votes(FIXTURE, 'id')}",
    "batch_stats": f"SELECT predicted_lang, count(*) AS n, round(avg(confidence), 4) AS mean_confidence, count(*) FILTER (WHERE confidence >= 0.75) AS n_confident FROM {votes('documents', 'doc_id')} GROUP BY 1",
    "quality_vs_label": f"SELECT CAST(quality AS BIGINT) AS quality, count(*) AS n, round(avg(qs), 6) AS mean_score FROM ({features('documents', 'doc_id', f'key AS doc_id, {QUALITY} AS qs')}) JOIN labels USING (doc_id) GROUP BY 1",
    "lang_hints": f"WITH {chars(FIXTURE, 'id')}, {shares(K.block_case('unicode(c)'), "'Unknown'", True)} SELECT t.key AS id, coalesce(h, '') AS hints FROM t LEFT JOIN (SELECT key, string_agg(k || '=' || {HINTS}, ';' ORDER BY k) AS h FROM sc GROUP BY key) x ON x.key = t.key",
    "char_script_names": "SELECT * FROM (VALUES " + ", ".join(f"({q(c)}, {q(s)})" for c, s in fixture.CHARACTERS) + ") v(c, script)",
    "char_in_script": f"SELECT c, code, CASE code {INSIDE} END AS inside FROM (VALUES " + ", ".join(f"({q(c)})" for c, _ in fixture.CHARACTERS) + f") v(c) CROSS JOIN (SELECT unnest([{', '.join(map(q, CODES))}]) AS code)",
    "seeded_order": f"SELECT doc_id, {SEEDED} AS place FROM documents",
    "similarity_matrix": f"SELECT * FROM (PIVOT (SELECT lang1, lang2, round(sim, 4) AS sim FROM {SIMILARITY} WHERE lang1 <> lang2) ON lang2 USING first(sim) GROUP BY lang1)",
    "full_report": f"""WITH c AS (SELECT * FROM {CLASSES}), a AS (SELECT sum(n) FILTER (WHERE "true" = pred) / sum(n) AS x, CAST(sum(n) AS BIGINT) AS s FROM {CONFUSION})
SELECT class, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM (
SELECT * FROM c UNION ALL SELECT 'accuracy', x, x, x, s FROM a UNION ALL SELECT 'macro avg', avg("precision"), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', sum("precision" * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c)""",
    "f1_bands": f"SELECT class, CASE WHEN f1 > 0.95 THEN 'high' WHEN f1 > 0.85 THEN 'medium' ELSE 'low' END AS band FROM {CLASSES}",
    "confidence_histogram": f"WITH j AS (SELECT * FROM {JUDGED}), e AS (SELECT min(confidence) AS lo, max(confidence) AS hi FROM j) SELECT CAST(CASE WHEN hi > lo THEN least(floor((confidence - lo) / (hi - lo) * 30), 29) ELSE 0 END AS BIGINT) AS bin, count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE NOT correct) AS n_wrong FROM j CROSS JOIN e GROUP BY 1",
    "vote_top_five": f"SELECT doc_id, string_agg(code || '=' || CAST(floor(p * 1e6 + 1e-3) AS BIGINT), ';' ORDER BY p DESC, code) AS top_5 FROM (SELECT doc_id, code, p, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, code) AS r FROM (SELECT doc_id, code, CASE WHEN code = rule_lang AND rule_confidence >= 0.55 THEN 0.3 * rule_confidence ELSE 0.0 END AS p FROM {rules('documents', 'doc_id')} CROSS JOIN (SELECT unnest([{', '.join(map(q, CODES))}]) AS code))) WHERE r <= 5 GROUP BY doc_id",
    "aligned_probabilities": "SELECT * FROM (VALUES (1::BIGINT, '0,25,0,50,0,0,0,0,0,0,0,0'), (2::BIGINT, '0,100,0,0,0,0,0,0,0,0,0,0')) v(id, hundredths)",
    "identified_texts": f"SELECT doc_id, ok AS accepted, CASE WHEN ok THEN l END AS predicted_lang, CASE WHEN ok THEN round(c, 4) END AS confidence, ok AND c >= 0.75 AS is_confident, CASE WHEN ok THEN {case_of('l', 2, q('Unknown'))} END AS script, CASE WHEN ok THEN {case_of('l', 5, q('LTR'))} END AS direction, n AS text_length FROM (SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n, length(coalesce(text, '')) BETWEEN 5 AND 10000 AS ok, coalesce(rule_lang, 'eng') AS l, CASE WHEN rule_lang IS NULL THEN 0.5 ELSE rule_confidence END AS c FROM {rules('documents', 'doc_id, text')})",
    "ngram_model_lang": EXPECTED.format("code AS id, code AS predicted_lang"),
    "word_model_lang": EXPECTED.format("code AS id, code AS predicted_lang"),
    "stacked_models": EXPECTED.format("code AS id, code AS predicted_lang"),
    "model_vote": EXPECTED.format("code AS id, code AS predicted_lang, code AS ngram, code AS words, code AS first_of_five"),
    "model_comparison": "SELECT * FROM (VALUES ('ngram', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 12::BIGINT), ('words', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE, 12::BIGINT)) v(model, accuracy, macro_f1, weighted_f1, n_samples)",
    "stream_profile": f"SELECT lang, token, n FROM {words_of("(SELECT lang, text FROM documents WHERE text <> '')")}",
}
