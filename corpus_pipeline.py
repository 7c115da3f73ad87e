"""A training corpus from raw documents: language ID, exact dedup, near dedup, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. A stage's scratch tables go when the next one begins.

What each stage does with odd rows:

* Null text: language ID drops it; later stages would treat it as empty (equal to other empty texts in exact dedup, linked
  with nothing in the n-gram join, kept null by PII, packed as the end token).
* Empty text, or text without a letter: dropped by language ID.
* Null ids and repeated ids: rows are told apart by a key of their own, so a row is dropped only for its own text. Of
  copies the largest id stays in exact dedup, the smallest in the n-gram join; a null id is smaller than any other.
* Repeated rows: one of them stays after exact dedup.
* Very long texts are read whole. An empty table gives an empty one with the same columns.
* Further columns pass through the first four stages unchanged, whatever their names (lang_pred, score, digest and the
  like included); a missing n_chars isn't made up. The last stage returns its own columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import exact_dedup, language_id, ngram_join, packing, pii
from cellweave.llm.scratch import cut, drop_owned, owned_by, small_batches
from cellweave.llm.tables import read

_BROADCAST_KEYS = 200_000  # keys of dropped rows sent to all tasks; more are joined by a shuffle
_KEY = "__key"  # (doc_id, number of the row): tells rows apart whose doc_id is null or repeated, and sorts as doc_id does


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key per row, written so that the keys stay as they are."""
    return cut(docs.withColumn(_KEY, F.struct("doc_id", F.monotonically_increasing_id().alias("row"))), "keyed")


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """keyed less the rows whose key is in `gone`, without the keys."""
    gone = cut(gone.select(F.col(f"{_KEY}.row").alias("__row")), "gone")
    rows = keyed.withColumn("__row", F.col(f"{_KEY}.row"))
    return rows.join(F.broadcast(gone) if gone.count() <= _BROADCAST_KEYS else gone, "__row", "left_anti").drop("__row", _KEY)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_owned(spark, __name__)
        with owned_by(__name__):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no text, or no letter in it. Where no labelled row may be learned from,
    and so no language is known, the texts are held to the same rule without a model."""
    model = language_id.train(docs, public_tokenizers.path("piece_bpe_32k.model"), ~language_id.held_out())
    with small_batches(spark):
        return cut(language_id.identified(docs, model), "identified")


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the largest doc_id stays, and one row of it."""
    keyed = _keyed(docs)
    files = keyed.inputFiles()[0].rsplit("/", 1)[0]
    return _without(keyed, exact_dedup.dedup_files(spark, files, id_col=_KEY).where(~F.col("kept")))


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.8 or more the smallest doc_id stays, and one
    row of it; a null doc_id is smaller than any other."""
    keyed = _keyed(docs)
    groups = ngram_join.join_documents(keyed, width=5, percent=80, id_col=_KEY)
    return _without(keyed, groups.where(F.col(_KEY) != F.col("component_id")))


@_stage
def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of personal data; n_chars follows the text."""
    with small_batches(spark):
        clean = cut(pii.redact(docs), "redacted")
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place the documents' tokens in sequences of at most 2048."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("pii", redact_pii),
    ("best_fit_packing", pack_sequences),
]

#: Tokenization and packing aren't expressible in SQL; tests hold the stages against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
