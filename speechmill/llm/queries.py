"""The queries of this folder, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import audio_features, backoff_lm, byte_bpe, hard_negatives, host_rules, huffman_ids, jaccard_join, license_scan, mixing, stream_dedup, toxicity, url_filter, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op3_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.select(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features.digests(table(spark, sf_dir, "documents"))


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = backoff_lm.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", (F.round("log_score", 4) + F.lit(0.0)).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.of_embeddings(table(spark, sf_dir, "embeddings"))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_stream_dedup": op3_stream_dedup,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_audio_features": op6_audio_features,
    "op7_huffman_ids": op7_huffman_ids,
    "op8_license_scan": op8_license_scan,
    "op9_backoff_lm": op9_backoff_lm,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_host_rules": op12_host_rules,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE_SQL = {
    "op3_stream_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM n""",
    "op4_mixing": mixing.oracle(),
    "op9_backoff_lm": backoff_lm.oracle(),
    "op11_hard_negatives": hard_negatives.oracle(),
    "op12_host_rules": host_rules.oracle(),
    "op13_vector_codes": vector_codes.oracle(),
    "op2_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT p.a, r.c FROM r JOIN p ON p.b = r.doc_id WHERE r.c < p.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, len(sh)""",
}
