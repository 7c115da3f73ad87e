"""Exact deduplication by keyed streaming state.

A stream over the documents' files keeps one state row per digest of the normalised text, on disk (RocksDB), without a
watermark, so nothing expires. The row holds how many rows had the digest, the stable identifier of the row that stays
(the largest id) and the locator of its content (its file). Rows are reduced per task before the state sees them, so
a text that a third of all rows share costs the state one row per task. Running the stream again over a folder with
new files goes on from the stored state.

The state is then read back as a table and joined to the documents by digest. Rows whose digest was seen more than
once are hits: the locator and the identifier lead to the text that stays, and their whole texts are compared with it. Texts
that share a digest and differ (never seen with SHA-256, made to happen in the tests) are grouped by the text itself.

Equal means identical after lower-casing A-Z only; null text counts as empty. Rows may repeat: each counts, and every
copy of the staying row is marked kept. A null id is smaller than any other; a group of null ids alone has a null
keep_id and keeps its rows. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.scratch import cut, new_path

_SALTED = 512  # rows of one text that meet it in a task
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    """Text with A-Z in lower case; null is empty. lower() changes nothing else in a text of ASCII bytes alone."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _streamable(spark: SparkSession, path: str) -> str:
    """A stream takes folders and patterns; a single file becomes a pattern that fits it alone."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.getFileStatus(p).isFile() else path


def _stored(spark: SparkSession, path: str, id_col: str, text_col: str, digest, state_path: str) -> DataFrame:
    """Run the stream over the files at `path` until all are read; the state as (digest, keep_id, file, n)."""
    # A session of its own, so that the caller's keeps its settings. Each partition's store would reserve megabytes of
    # disk ahead of need, and upload snapshots where changes do.
    own, rocks = spark.newSession(), "spark.sql.streaming.stateStore.rocksdb"
    keys = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false", f"{rocks}.allowFAllocate": "false", f"{rocks}.changelogCheckpointing.enabled": "true"}
    # All stores of an executor share one bounded cache, and buffers are small: a partition's state is a few megabytes.
    keys |= {f"{rocks}.boundedMemoryUsage": "true", f"{rocks}.maxMemoryUsageMB": "96", f"{rocks}.writeBufferSizeMB": "4"}
    for k, v in (keys | {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}).items():
        own.conf.set(k, v)
    given = own.read.parquet(path).schema
    schema = T.StructType([f for f in given if f.name in (id_col, text_col)])
    stream = own.readStream.schema(schema).parquet(_streamable(own, path))
    seen = stream.select(digest(normalised(F.col(text_col))).alias("digest"), F.struct(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file")).alias("at"))
    state = seen.groupBy("digest").agg(F.max("at").alias("at"), F.count(F.lit(1)).alias("n"))
    query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", state_path).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.format("statestore").load(state_path)


def dedup_files(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex, state_path: str | None = None) -> DataFrame:
    """Group the rows of the Parquet files at `path` by equal text. Per row: id_col, keep_id, group_size, kept,
    text_sha256 and keep_file (the locator). state_path: where the state is kept for a later run."""
    state_path = state_path or new_path(spark, "dedup-state")
    raw = _stored(spark, path, id_col, text_col, digest, state_path)
    value = raw.schema["value"].dataType.names
    state = raw.select(F.col("key.digest").alias("digest"), F.col("value")[value[0]].alias("at"), F.col("value")[value[1]].alias("n"))
    state = state.select("digest", F.col("at.id").alias("keep_id"), F.col("at.file").alias("keep_file"), "n")

    text = normalised(F.col(text_col))
    docs = spark.read.parquet(path).select(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), text.alias("text")).withColumn("digest", digest(F.col("text")))
    seen = docs.join(state, "digest")
    alone = F.col("n") == 1
    # One pass shuffles the texts; what is kept of it are keys, and the texts of hits.
    seen = cut(seen.select("id", "file", "digest", "keep_id", "keep_file", "n", F.sha2("text", 256).alias("text_sha256"), F.when(~alone, F.col("text")).alias("text")), "dedup-hits")
    hits = seen.where(~alone)
    # The locator leads to the text that stays. It is written once, and meets its hits split over as many tasks as
    # they fill: _SALTED rows of a group go to each.
    located = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("file") == F.col("keep_file"))
    parts = F.ceil(F.col("n") / _SALTED).cast("int")
    stays = cut(hits.where(located).groupBy("digest", "n").agg(F.max("text").alias("keep_text")), "dedup-stays")
    stays = stays.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    salted = hits.withColumn("salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int"))
    checked = salted.join(stays, ["digest", "salt"]).withColumn("same", F.col("text") == F.col("keep_text"))
    checked = cut(checked.select("id", "digest", "keep_id", "keep_file", "n", "text_sha256", F.when(~F.col("same"), F.col("text")).alias("other")), "dedup-checked")

    # Texts behind a shared digest that differ: groups of their own, and fewer rows in the group that they left.
    apart = checked.where(F.col("other").isNotNull())
    own = apart.groupBy("digest", "other").agg(F.max("id").alias("own_id"), F.count(F.lit(1)).alias("own_n"))
    left = apart.groupBy("digest").agg(F.count(F.lit(1)).alias("gone"))
    if apart.isEmpty():
        hits = checked.drop("other")
    else:
        hits = checked.join(left, "digest", "left").join(own, ["digest", "other"], "left")
        moved = F.col("other").isNotNull()
        hits = hits.select(
            "id", "digest", F.when(moved, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(~moved, F.col("keep_file")).alias("keep_file"),
            F.when(moved, F.col("own_n")).otherwise(F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"), "text_sha256",
        )
    out = seen.where(alone).drop("text", "file").unionByName(hits)
    return out.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_file")


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256_hex) -> DataFrame:
    """dedup_files over any frame, which is written to the shared folder first (a stream reads files)."""
    path = new_path(df.sparkSession, "dedup-input")
    df.select(id_col, text_col).write.parquet(path)
    return dedup_files(df.sparkSession, path, id_col, text_col, digest)
