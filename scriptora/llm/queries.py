"""One query for each operator of this subpackage, over its whole table, and SQL where that can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptora.llm import embed_dedup, html_extract, mixing, packing, quality, secret_scan, sharding, simhash, token_files, warc


def tokenizer_path() -> str:
    """The tokenizer file of the packing and token-file queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_round_trip(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_best_fit_packing, op3_embedding_dedup, op4_sharding, op5_source_mixing, op6_simhash_dedup, op7_token_files, op8_warc_archives, op9_secret_scan, op10_quality_rules)
}

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings
  UNION
  SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen
), least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT m.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = m.vec_id) AS BIGINT) AS n_links, l.component_id, m.vec_id = l.component_id AS kept
FROM embeddings m JOIN least l ON l.node = m.vec_id
""",
    "op5_source_mixing": """
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY source
), w AS (
  SELECT *, CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2.0::DOUBLE * source_size / (CASE k % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END) AS full_at FROM s
), c AS (
  SELECT *, coalesce(sum(2 * source_size) OVER o, 0) AS clamped, sum(weight) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM w WINDOW o AS (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT max((1.5 * (SELECT sum(source_size) FROM s) - clamped) / open_weight) AS v FROM c
), t AS (
  SELECT source, source_size, least(2.0 * source_size, weight * (SELECT v FROM level))::DOUBLE AS target FROM w
), r AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN target >= 2 * source_size THEN 2 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t
), o AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, greatest(0, CAST(round(r.target) AS BIGINT) - r.whole * r.source_size) AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('17:' || d.doc_id), d.doc_id ROWS UNBOUNDED PRECEDING) - d.size AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM o
""",
    "op8_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest FROM pages),
m AS (SELECT digest, max(page_id) AS target FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY digest)
SELECT p.page_id, CAST(octet_length(encode(p.html)) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN m.target <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m.target <> p.page_id THEN m.target END AS refers_to
FROM p LEFT JOIN m ON p.digest = m.digest
""",
}
