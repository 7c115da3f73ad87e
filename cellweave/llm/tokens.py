"""BPE encoding and decoding over tables, and the exact histogram of encoded lengths.

Rows: null text counts as empty (no ids). Repeated rows give repeated results, other columns are ignored, an empty
table gives an empty result. One text is held in memory at a time, besides its Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import bpe_automaton
from cellweave.llm.scratch import cut


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for x in batch.column(name):
        yield x.as_py() or ""


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = False, decoded: bool = False) -> DataFrame:
    """Encode every whole text; per row: id_col, n_tokens, and as asked for

    ids      array<int> of token ids,
    digests  ids_sha256 over the ids as little-endian uint32, decoded_sha256 over the decoded text in UTF-8,
    decoded  the decoded text.
    """
    id_type = df.schema[id_col].dataType
    fields = [T.StructField(id_col, id_type), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    fields += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    fields += [T.StructField("decoded", T.StringType())] * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe_automaton.load(vocab_path)
        for batch in batches:
            cols: list[list] = [[] for _ in fields[1:]]
            for text in _texts(batch, "__text"):
                raw = tokenizer.encode_bytes(text)
                row: list = [len(raw) // 4]
                if ids:
                    row.append(memoryview(raw).cast("I").tolist())
                if digests or decoded:
                    back = tokenizer.decode_bytes(raw)
                    if digests:
                        row += [hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()]
                    if decoded:
                        row.append(back.decode())
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
            yield pa.RecordBatch.from_arrays([batch.column("__id"), *(pa.array(c, kinds.get(f.name, pa.string())) for c, f in zip(cols, fields[1:], strict=True))], names=[f.name for f in fields])

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode arrays of ids by emitting arc labels; per row: id_col, decoded (null ids: empty)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe_automaton.load(vocab_path)
        for batch in batches:
            texts = [tokenizer.decode([i for i in x.as_py() or () if i is not None]) for x in batch.column("__ids")]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(texts, pa.string())], names=[id_col, "decoded"])

    return df.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def _running(df: DataFrame, block: Column, order: str, sums: dict[str, str], upward: bool) -> DataFrame:
    """Add running sums along `order`, in blocks: within a block by a window, over blocks by their few totals."""
    df = df.withColumn("__b", block)
    totals = df.groupBy("__b").agg(*(F.sum(c).alias(f"__t_{out}") for out, c in sums.items()))
    rest = Window.orderBy(F.col("__b") if upward else F.col("__b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("__b", *(F.coalesce(F.sum(f"__t_{out}").over(rest), F.lit(0)).alias(f"__o_{out}") for out in sums))
    inside = Window.partitionBy("__b").orderBy(F.col(order) if upward else F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    for out, c in sums.items():
        df = df.withColumn(out, F.sum(c).over(inside))
    df = df.join(before, "__b")
    return df.select(*(c for c in df.columns if not c.startswith("__") and c not in sums), *((F.col(out) + F.col(f"__o_{out}")).alias(out) for out in sums))


def length_histogram(lengths: DataFrame, col: str = "n_tokens", block: int = 1024) -> DataFrame:
    """The exact histogram of document lengths with its sums; one row per length that occurs.

    n_tokens, n_docs         the length and the documents of it
    docs_le, tokens_le       documents up to this length, and their tokens
    docs_ge, tokens_ge       suffix sums: documents of at least this length, and their tokens
    tokens_within            tokens left if every document is cut to a context of n_tokens
    share_le                 part of the documents up to this length (the quantile of n_tokens)

    ``answer`` reads totals, quantiles and truncated totals for any limit off this table. The rows are distinct
    lengths, not documents: documents are counted before the shuffle, and the running sums work in blocks of lengths.
    A null length counts nowhere.
    """
    h = lengths.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    h = h.withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    # Written once: the sums read it several times, and the texts must not be encoded again for each.
    h = cut(h.withColumnRenamed("__tokens", "own_tokens"), "histogram")
    at = F.floor(F.col("n_tokens") / block)
    h = _running(h, at, "n_tokens", {"docs_ge": "n_docs", "tokens_ge": "own_tokens"}, upward=False)
    h = _running(h, at, "n_tokens", {"docs_le": "n_docs", "tokens_le": "own_tokens"}, upward=True)
    total = F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")
    return h.select(
        "n_tokens", "n_docs", "docs_le", "tokens_le", "docs_ge", "tokens_ge",
        (F.col("tokens_le") + F.col("n_tokens") * (F.col("docs_ge") - F.col("n_docs"))).alias("tokens_within"),
        (F.col("docs_le") / total).alias("share_le"),
    )


def answer(histogram: DataFrame, limits: list[int], quantiles: list[float] = ()) -> DataFrame:
    """Read a histogram: per context limit the documents that fit, those that don't, and the tokens left after cutting;
    per quantile the smallest length that at least this part of the documents doesn't exceed. Columns: kind, asked,
    docs_fit, docs_cut, tokens_total, tokens_within, n_tokens."""
    h = histogram
    asked = h.sparkSession.createDataFrame([(int(x),) for x in dict.fromkeys(limits)], "limit long")
    fit = F.col("n_tokens") <= F.col("limit")
    own = F.col("n_tokens") * F.col("n_docs")
    # Limits are a stated short list: every histogram row meets each of them once.
    by_limit = h.join(F.broadcast(asked)).groupBy("limit").agg(
        F.sum(F.when(fit, F.col("n_docs")).otherwise(0)).alias("docs_fit"), F.sum(F.when(fit, 0).otherwise(F.col("n_docs"))).alias("docs_cut"),
        F.sum(own).alias("tokens_total"), F.sum(F.least("n_tokens", "limit") * F.col("n_docs")).alias("tokens_within"),
    )
    out = by_limit.select(F.lit("limit").alias("kind"), F.col("limit").cast("double").alias("asked"), "docs_fit", "docs_cut", "tokens_total", "tokens_within", F.lit(None).cast("long").alias("n_tokens"))
    none = F.lit(None).cast("long")
    for q in quantiles:
        at = h.where(F.col("share_le") >= F.lit(float(q))).agg(F.min("n_tokens").alias("n_tokens"))
        out = out.unionByName(at.select(F.lit("quantile").alias("kind"), F.lit(float(q)).alias("asked"), *(none.alias(c) for c in ("docs_fit", "docs_cut", "tokens_total", "tokens_within")), "n_tokens"))
    return out
