"""Seeded sampling and splitting. Random order is the order of md5(seed|key): the same on any partitioning."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def draw(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def one_per_group(df: DataFrame, by: list[str], key: str, seed: int = 42) -> DataFrame:
    """One random row of each group."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(draw(seed, F.col(key)), key)).alias("__row")).select(*by, "__row.*")


def first_tables(df: DataFrame, table: str, n: int, order: str = "ord") -> DataFrame:
    """Rows read until the first row of table n + 1; later rows of the first n tables aren't seen."""
    firsts = df.groupBy(table).agg(F.min(order).alias("__first")).orderBy("__first").limit(n + 1)
    cut = firsts.orderBy(F.col("__first").desc()).limit(1).join(firsts.agg(F.count(F.lit(1)).alias("__n"))).where(F.col("__n") > n).select("__first")
    # One row or none: without a table n + 1 there is no cut.
    return df.join(F.broadcast(cut), F.col(order) >= F.col("__first"), "left_anti")


def last_tables(df: DataFrame, table: str, n: int, order: str = "ord") -> DataFrame:
    """Rows of the n tables that end last."""
    lasts = df.groupBy(table).agg(F.max(order).alias("__last")).orderBy(F.col("__last").desc()).limit(n)
    return df.join(lasts.select(table), table, "left_semi")


_SLICES = 4  # hex digits of a draw by which rows are counted: 65,536 counts at most


def split(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    """Column is_eval for max(1, round(n * ratio)) random rows (ties of the half to even). Rows are counted by the first
    digits of their draw; all rows of the low slices are in, and only the slice that the share ends in is ranked."""
    drawn = df.withColumn("__draw", draw(seed, F.col(key))).withColumn("__slice", F.left("__draw", F.lit(_SLICES)))
    counts = sorted((r["__slice"], r["n"]) for r in drawn.groupBy("__slice").agg(F.count(F.lit(1)).alias("n")).collect())
    left, last = max(1, round(sum(n for _, n in counts) * ratio)), ""
    for last, n in counts:  # noqa: B007
        if n >= left:
            break
        left -= n
    edge = drawn.where(F.col("__slice") == last).select(key, F.row_number().over(Window.orderBy("__draw", key)).alias("__r"))
    chosen = edge.where(F.col("__r") <= left).select(key).distinct().withColumn("__eval", F.lit(True))
    out = drawn.join(F.broadcast(chosen), key, "left")
    return out.withColumn("is_eval", (F.col("__slice") < last) | F.coalesce("__eval", F.lit(False))).drop("__eval", "__draw", "__slice")


def sample(df: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    return df.orderBy(draw(seed, F.col(key)), key).limit(most)


def shuffled(items: Column, seed: int, key: Column) -> Column:
    """An array in random order, its own for each key."""
    drawn = F.transform(items, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), x, i.cast("string"))).alias("h"), x.alias("x")))
    return F.transform(F.array_sort(drawn), lambda d: d["x"])


def shard(order: Column, of: int, nth: int) -> Column:
    return F.pmod(order, F.lit(of)) == nth


def balanced(df: DataFrame, size: Column, workers: int, order: str = "ord") -> DataFrame:
    """Largest first to the least loaded worker, the first of those with equal loads. The greedy order runs over all
    rows, so the sizes (a key and a number per row, not the rows) go through one task as a sorted stream, which keeps one
    load per worker and nothing else."""
    key_type = df.schema[order].dataType
    sizes = df.select(order, size.cast("long").alias("__size"))
    # One partition in a stable order: sizes down, then the order.
    ordered = sizes.repartition(1).sortWithinPartitions(F.col("__size").desc(), F.col(order))

    def run(batches):
        loads = [(0, w) for w in range(workers)]
        for batch in batches:
            out = []
            for n in batch.column(1).to_pylist():
                load, w = heapq.heappop(loads)
                out.append(w)
                heapq.heappush(loads, (load + (n or 0), w))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=[order, "worker"])

    placed = ordered.mapInArrow(run, T.StructType([T.StructField(order, key_type), T.StructField("worker", T.IntegerType())]))
    return df.join(placed, order)


def per_group(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group (samples of a report)."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def nth(df: DataFrame, n: int, order: str) -> DataFrame:
    """The row with number n (from 0) in the order; stops the query if there is none."""
    if n < 0:
        raise ValueError("n must not be negative")
    row = df.orderBy(order).offset(n).limit(1)
    there = row.agg(F.count(F.lit(1)).alias("__n")).select(F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit(f"there is no row {n}")).cast("boolean")).alias("__ok"))
    return row.join(F.broadcast(there), F.col("__ok"), "right").drop("__ok")


def limit_or_none(n: int | None) -> int | None:
    """A limit of zero or less means none."""
    return n if n is not None and n > 0 else None
