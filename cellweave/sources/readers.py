"""Readers: text lines with their order, JSON lines, large JSON arrays, table files, dumps."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.sampling import limit_or_none

TABLE_JSON = T.StructType([
    # Matrices are read row by row as raw JSON: one row that is no list must not void the whole table.
    *(T.StructField(c, T.ArrayType(T.StringType())) for c in ("text", "cells", "link", "entity")),
    T.StructField("header", T.ArrayType(T.StringType())), T.StructField("caption", T.StringType()),
    T.StructField("external_context", T.MapType(T.StringType(), T.StringType())), T.StructField("__bad", T.StringType()),
])


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and ord of text files, compressed or not; ord counts from 0 along file names, then lines, blank ones
    included. Lines are numbered inside the blocks that tasks read, and only the blocks' counts meet."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__s"), F.monotonically_increasing_id().alias("__at"))
    counts = raw.groupBy("__f", "__s").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__f", "__s").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__f", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    nth = F.row_number().over(Window.partitionBy("__f", "__s").orderBy("__at"))
    return raw.withColumn("__nth", nth).join(F.broadcast(base), ["__f", "__s"]).select("value", (F.col("__base") + F.col("__nth") - 1).alias("ord"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, errors: str = "skip", most: int | None = None) -> DataFrame:
    """Objects of JSON lines, blank lines left out. errors: "skip" drops bad lines, "fail" stops, "keep" adds them as
    __bad (to be counted), "strict" stops at lines that hold another value than an object as well. most: the first so many."""
    if errors == "strict":
        raw = lines(spark, path).where(F.trim("value") != "")
        whole = F.startswith(F.ltrim("value"), F.lit("{"))
        checked = F.when(whole, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("line is not an object: "), "ord")))
        out = raw.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("o"), "ord").orderBy("ord").select("o.*")
    elif errors == "keep":
        schema = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
        out = spark.read.schema(schema).option("columnNameOfCorruptRecord", "__bad").json(path)
    else:
        out = spark.read.schema(schema).option("mode", {"skip": "DROPMALFORMED", "fail": "FAILFAST"}[errors]).json(path)
    return out if limit_or_none(most) is None else out.limit(most)


def shards(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """JSON lines of shard files with `shard`, their place in the list, and `ord` inside the shard; one that is missing
    stops the query, which Spark's readers do by themselves for a path that isn't there."""
    out = None
    for i, path in enumerate(paths):
        one = lines(spark, path).where(F.trim("value") != "").select(F.lit(i).alias("shard"), "ord", F.from_json("value", schema).alias("o")).select("shard", "ord", "o.*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no shards")
    return out


def tables(spark: SparkSession, path: str, dropped: bool = False) -> DataFrame:
    """One row per table file, with `ord`, its place by name; files that don't parse go, or are all that is returned (as
    source_file) if `dropped`. Matrix rows that are no lists are null."""
    raw = spark.read.schema(TABLE_JSON).option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(path).select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"))
    if dropped:
        # The bad column alone can't be read: Spark wants another one of the file's along with it.
        return raw.select("source_file", "caption", "__bad").where(F.col("__bad").isNotNull()).select("source_file")
    names = raw.select("source_file").distinct()
    names = names.withColumn("ord", (F.row_number().over(Window.orderBy("source_file")) - 1).cast("long"))
    raw = raw.where(F.col("__bad").isNull()).join(names, "source_file")
    matrix = lambda c: F.transform(F.col(c), lambda r: F.from_json(r, "array<string>"))
    return raw.select("source_file", "ord", "header", "caption", "external_context", *(matrix(c).alias(c) for c in ("text", "cells", "link", "entity")))


def objects(chunks: Iterator[str]) -> Iterator[str]:
    """Top-level objects of a JSON array, by matching braces outside strings; memory is one object."""
    depth, quoted, escaped, own = 0, False, False, []
    for chunk in chunks:
        start = 0 if depth else None
        for i, c in enumerate(chunk):
            if depth and quoted:
                if escaped:
                    escaped = False
                elif c == "\\":
                    escaped = True
                elif c == '"':
                    quoted = False
            elif c == '"' and depth:
                quoted = True
            elif c == "{":
                if not depth:
                    start = i
                depth += 1
            elif c == "}" and depth:
                depth -= 1
                if not depth:
                    own.append(chunk[start : i + 1])
                    yield "".join(own)
                    own, start = [], None
        if depth:
            own.append(chunk[start:])


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of large JSON arrays, one task per file; objects that don't decode go. Files come through Spark's
    reader in lines, so any store it reads will do, and no task holds more than a line batch and one object."""
    raw = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    by_file = raw.repartition("file").sortWithinPartitions("file", "start", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[str]:
            last = None
            for b in batches:
                for value, file in zip(b.column("value").to_pylist(), b.column("file").to_pylist(), strict=True):
                    if last not in (None, file):
                        yield "\x00"
                    last = file
                    yield value + "\n"

        out = []
        for o in objects(parts()):
            try:
                json.loads(o)
            except ValueError:
                continue
            out.append(o)
            if len(out) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return by_file.mapInArrow(run, "value string").select(F.from_json("value", schema).alias("o")).select("o.*")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines or a JSON array, by the file's extension."""
    return json_lines(spark, path, schema) if path.endswith(("jsonl", "jsonl.gz", "jsonl.bz2")) else json_array(spark, path, schema)
