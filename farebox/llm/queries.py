"""The registered queries of the corpus operators, one per operator, over the
whole of their tables; and DuckDB text where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farebox.llm import common as C
from farebox.llm import (alignment, decontam, fingerprints, hard_negatives, html_text, language, neardup, orc_ids, packing,
                         quality, sharding, toxicity, vector_dedup)
from farebox.session import work_path

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = language.fit(docs, ~C.in_fold("_id", 5, 0))
    return language.predict(docs.select("doc_id", "text"), net).select(
        "doc_id", C.in_fold("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; every machine has them at the same place."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "token-orc")
    orc_ids.write(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return orc_ids.digest(orc_ids.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extract(pages.select("page_id", "url", "html"), html_text.fit(pages)).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cluster(table(spark, sf_dir, "documents"), neardup.Config(words=4)).select(
        "doc_id", "n_shingles", "component_id", "kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~C.in_fold("_id", 3, 1))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", C.in_fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~C.in_fold("_id", 5, 0))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", C.in_fold("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=24, law="bytes")


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.cluster(table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                           tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_token_orc": op3_token_orc,
    "op4_html_text": op4_html_text,
    "op5_fingerprints": op5_fingerprints,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality": op7_quality,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_alignment": op13_alignment,
}

OP11_SQL = """
WITH RECURSIVE rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
usable AS (
  SELECT vec_id, v FROM rows
  WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(r.vec_id, l.b) AS component_id, r.vec_id = least(r.vec_id, l.b) AS kept
FROM rows r LEFT JOIN lowest l ON l.a = r.vec_id LEFT JOIN counts c ON c.a = r.vec_id
"""

OP12_SQL = """
WITH rows AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, r.label = a.label AS same, list_inner_product(a.q, r.q)::BIGINT AS score
  FROM rows a JOIN rows r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op11_vector_dedup": OP11_SQL, "op12_hard_negatives": OP12_SQL}
