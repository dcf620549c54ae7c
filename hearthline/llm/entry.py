"""The queries op1 to op13: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, dialogue, extraction, fingerprint, langid, lm, mixing, packing, quality, sharding, simhash, topk, urlfilter
from .common import text_or_empty

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document. Null text is empty, null source or lang a group of its own; a score at the threshold is kept; repeated rows are judged one by one; other columns are dropped."""
    judged = quality.classify(_read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"), _read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "source", "lang", "doc_score", "host_posterior", "path_posterior", F.col("quality_score").alias("score"), "keep")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of every query row. Vectors that are null or hold null or non-finite components take no part; repeated ids stay apart; ties go to the smaller id; an empty table gives no row."""
    return topk.exact_topk(_read(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model score of every document. Null text scores its end token; repeated rows score alike; without training rows base is 0; an empty table gives no row."""
    return lm.score_documents(_read(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of every document. Null or empty text is one piece; repeated rows are packed one by one; long texts are cut whole; an empty table gives no row."""
    import public_tokenizers

    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document. Null text is empty, no word gives zero; repeated rows share a component; a null doc_id names none unless there is no other; an empty table gives no row."""
    rows = simhash.components(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and labelled spans of every document. Null text or none with a letter is `und`; repeated rows are predicted alike; equal masses go to the first language by name; an empty table gives no row."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page. A null URL, or one without ://, has empty host and path; of equally long rules the first counts; repeated rows are judged alike; an empty table gives no row."""
    judged = urlfilter.judge_urls(_read(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document and of its edited text. Null text is empty; a null doc_id is the smallest; rows that share a doc_id share the next document; an empty table gives no row."""
    return fingerprint.fingerprint_documents(_read(spark, sf_dir, "documents")).drop("edited")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Null text has size 1; rows equal in all columns are dealt like any others; ties are ordered by seeded hashes; an empty table gives no row."""
    docs = _read(spark, sf_dir, "documents")
    text = text_or_empty(docs)
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    return sharding.shard_rows(rows, 16).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of every document. Null text has size 0; null is the last source; rows alike in id, source and text get the same copies; an empty table gives no row."""
    plan = mixing.plan_copies(_read(spark, sf_dir, "documents"))
    row = F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))
    return plan.withColumn("_row", row).select(
        F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_source").alias("source"), F.col("_copies").alias("copies"),
    )


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, links and their corpus counts of every document. Null or empty text, and text that a tokenizer's bytes don't give back, has zeros and an empty digest; repeated rows count each; long texts are aligned whole; columns of other names are ignored; an empty table gives no row."""
    import public_tokenizers

    return alignment.align_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null html, or a page without text, gives an empty text; repeated rows are extracted one by one; long pages are read whole; columns of other names are ignored; an empty table gives no row."""
    return extraction.extract_pages(_read(spark, sf_dir, "pages"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and its digest of every conversation. Null role and text are one space, a null turn comes first, a null conversation is one of its own; turns of one number go by role initial and digest; equal rows are repeats; long texts and conversations are repaired whole; columns of other names are ignored; an empty table gives no row."""
    return dialogue.audit(dialogue.damage(_read(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    every = (
        op1_quality_classifier, op2_exact_topk, op3_lm_scoring, op4_packing, op5_simhash, op6_language_id, op7_url_filter, op8_fingerprint, op9_sharding, op10_mixing,
        op11_tokenizer_alignment, op12_html_extraction, op13_conversation_repair,
    )
    return {q.__name__: q for q in every}


#: Rules as the contract lists them: (verdict, host, path).
_OP7 = """
WITH parts AS (
  SELECT page_id, lower_az, rest FROM (
    SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, '' AS lower_az FROM pages)
), cut AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), listed(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM cut JOIN listed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule,
  coalesce(best.verdict, CASE WHEN regexp_matches(host || path, '/wp-(admin|login)\\b|/(cart|checkout)(/|$)|/calendar/[0-9]{4}/[0-9]{1,2}\\b|^(ads?|adserver|doubleclick)\\.|\\bcasino\\b|\\bporn\\b') THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN best USING (page_id)
"""

_OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.row AS query_row, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": _OP2, "op7_url_filter": _OP7}
