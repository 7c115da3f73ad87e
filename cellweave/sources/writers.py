"""Writers: JSON lines, a JSON array, a data set with its audit rows, bucketed indexes, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.sources import readers


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def json_array(df: DataFrame, path: str, order: str, batch: int = 500) -> None:
    """One array file, in any store that Spark writes to, for exports that a single reader takes whole. Rows pass the
    driver one partition at a time."""
    _write_array(df.orderBy(order).select(F.to_json(F.struct("*")).alias("j")), path, batch)


def _write_array(texts: DataFrame, path: str, batch: int) -> None:
    p, fs = _file_system(texts.sparkSession, path)
    out = fs.create(p, True)
    try:
        own, first = ["["], True
        for r in texts.toLocalIterator():
            own.append(("" if first else ",") + "\n" + json.dumps(json.loads(r["j"]), ensure_ascii=False, indent=2))
            first = False
            if len(own) >= batch:
                out.write("".join(own).encode())
                own = []
        out.write(("".join(own) + "\n]\n").encode())
    finally:
        out.close()


def replace(df: DataFrame, path: str) -> None:
    """Write JSON lines beside the path, then put them in its place, so that readers see the old rows or the new ones."""
    spark = df.sparkSession
    beside = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.tmp"
    df.write.json(beside)
    (new, fs), (old, _) = _file_system(spark, beside), _file_system(spark, path)
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"cannot rename {beside} to {path}")


def rank_shards(df: DataFrame, path: str, rank: str = "rank") -> None:
    """Add rows to one folder per rank; Spark's commit makes a task's rows appear whole or not at all."""
    df.write.mode("append").partitionBy(rank).json(path)


def convert_lines(spark: SparkSession, lines_path: str, array_path: str) -> None:
    """JSON lines to one array file, in the lines' order."""
    rows = readers.lines(spark, lines_path).where(F.trim("value") != "")
    _write_array(rows.orderBy("ord").select(F.col("value").alias("j")), array_path, 500)


def output_name(stem: str, rows: int | None = None, model: str = "", variant: str = "", extension: str = "jsonl") -> str:
    """The name of an output: its stem, the rows in thousands, a tag of the model and a variant."""
    tag = "-".join(model.replace("/", " ").split()[-1:])
    parts = [stem, f"{rows // 1000}k" if rows else "", tag, variant]
    return "_".join(p for p in parts if p) + f".{extension}"


def data_and_audit(df: DataFrame, data: list[str], audit: list[str], path: str) -> None:
    """Two row-aligned sets from one written parent."""
    df.write.mode("overwrite").parquet(f"{path}/all")
    whole = df.sparkSession.read.schema(df.schema).parquet(f"{path}/all")
    whole.select(*data).write.mode("overwrite").json(f"{path}/data")
    whole.select(*audit).write.mode("overwrite").json(f"{path}/audit")


def index_table(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A table bucketed and sorted by its lookup key, so that joins on the key need no shuffle of it."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
