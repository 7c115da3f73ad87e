"""Jobs from a folder that grows: each is handled once, and a restart goes on where the last run ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_new_jobs(spark: SparkSession, path: str, schema: T.StructType, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "job_id") -> None:
    """Read what is new, drop keys that `out` has, append the results; stops when all files are read."""

    def batch(df: DataFrame, number: int) -> None:
        df = df.dropDuplicates([key])
        try:
            done = spark.read.parquet(out).select(key)
        except Exception as e:  # the first batch has no output yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        handle(df if done is None else df.join(done, key, "left_anti")).write.mode("append").parquet(out)

    spark.readStream.schema(schema).json(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per window and type of a stream; late ones count until the watermark passes."""
    return events.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")
