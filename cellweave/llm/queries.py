"""The queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cellweave.llm import exact_dedup, language_id, license_scan, ngram_join, packing, pii, secrets_scan, tokens, vector_dedup
from cellweave.llm.tables import read

VOCAB = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_files(spark, f"{sf_dir}/documents.parquet").drop("keep_file")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link(read(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_documents(read(spark, sf_dir, "documents"), width=3, percent=90)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), capacity=2048, end_id=0)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.train(docs, public_tokenizers.path(PIECES), ~language_id.held_out())
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokens.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), ids=False)
    return tokens.length_histogram(lengths)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCAB), ids=False, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_embedding_near_dedup, op3_secret_scan, op4_ngram_jaccard_join, op5_pii, op6_license_scan, op7_best_fit_packing, op8_language_id, op9_token_counts, op10_bpe)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _EXACT_DEDUP, "op3_secret_scan": secrets_scan.oracle(), "op6_license_scan": license_scan.oracle()}
