"""Tables that cut lineage, written to the folder all executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop) a folder
under the driver's temp directory is used, which is right for ``local[*]`` and nothing else.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{tempfile.gettempdir()}/cellweave-scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


_owned: dict[str, list[str]] = {}
_owner: list[str] = []


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    if _owner:
        _owned.setdefault(_owner[-1], []).append(path)
    return path


@contextmanager
def owned_by(name: str) -> Iterator[None]:
    """Scratch tables made inside belong to `name`."""
    _owner.append(name)
    try:
        yield
    finally:
        _owner.pop()


def drop_owned(spark: SparkSession, name: str) -> None:
    """Remove all tables of an owner; for when what was made from them has been written."""
    for path in _owned.pop(name, []):
        drop(spark, path)
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps, which it does once their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Python workers get so many rows at once in what is run inside. A batch stands several times in the memory of an
    executor and its workers, so batches of whole texts should be small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of it; survives the loss of any executor."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later step reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_table(df: DataFrame) -> None:
    """Remove the files behind a frame that cut() returned."""
    files = df.inputFiles()
    if files:
        drop(df.sparkSession, files[0].rsplit("/", 1)[0])
