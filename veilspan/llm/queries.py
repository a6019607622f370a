"""Registered queries of the corpus operators, and the SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm import bpe, fingerprints, knn, license_scan, near_dup, packing, quality, suffix_lm, toxicity, warc
from veilspan.llm._spark import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(table(spark, sf_dir, "documents"))


def _op1_sql() -> str:
    base = [t for t in license_scan.TEMPLATES if t.base]
    notices = [t for t in license_scan.TEMPLATES if not t.base]
    phrases = [(license_scan.parse(t.markup), t.label) for t in base]
    places = " || ".join(f"list_filter(range(len(w)), lambda i: array_to_string(w[i + 1 : i + {len(p)}], ' ') = '{' '.join(p)}')" for p, _ in phrases)
    has = [(f"contains(s, ' {' '.join(p)} ')", label) for p, label in phrases]
    full = [(f"regexp_matches(s, '[ ]{license_scan.pattern_sql(license_scan.parse(t.markup))}')", t.label) for t in notices]
    cases = lambda found: "[" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for c, label in found) + "]"
    joined = lambda found: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({cases(found)}, lambda x: x IS NOT NULL))), ','), '')"
    return f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), joined AS (
  SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s FROM words
), placed AS (
  SELECT *, CASE WHEN {' OR '.join(c for c, _ in has)} THEN {places} ELSE [] END AS p FROM joined
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(p)::BIGINT AS first_word, list_max(p)::BIGINT AS last_word,
  {joined(has)} AS base_labels, {joined(has + full)} AS labels,
  CASE WHEN {' OR '.join(c for c, _ in full)} THEN 1.0::DOUBLE WHEN len(p) > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score
FROM placed"""


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, usable=~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, usable=~toxicity.held_out())
    return quality.score(docs, model).withColumns({"held_out": toxicity.held_out(), "predicted": (F.col("score") >= quality.KEEP).cast("int")})


def op4_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.knn_join(table(spark, sf_dir, "embeddings"), is_query=F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


_OP4_SQL = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.v, d.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM valid q, valid d WHERE q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))
    return made.select("page_id", "warc_type", "record_id", "refers_to", "concurrent_to", "target_uri", "source_payload_digest", "block_digest", "n_links", "title", F.length("record").cast("long").alias("record_length"), F.sha2("record", 256).alias("record_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op10_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents"), training=F.crc32(F.col("doc_id").cast("string")) % 10 != 0)


def queries() -> dict:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_toxicity": op2_toxicity,
        "op3_quality_cotraining": op3_quality_cotraining,
        "op4_voronoi_knn": op4_voronoi_knn,
        "op5_packing": op5_packing,
        "op6_fingerprints": op6_fingerprints,
        "op7_warc_derivatives": op7_warc_derivatives,
        "op8_bpe": op8_bpe,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_suffix_lm": op10_suffix_lm,
    }


def oracle_sql() -> dict:
    return {"op1_license_scan": _op1_sql(), "op4_voronoi_knn": _OP4_SQL}
