"""Combine sources: positional zip, main-wins and last-wins merges, deltas, resume, ordered unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import strict_candidates
from cellweave.operators.sampling import shuffled


def _last(df: DataFrame, key: str, order, largest: bool = True) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    pick = F.max_by if largest else F.min_by
    return df.groupBy(key).agg(pick(F.struct(*rest), order).alias("__row")).select(key, "__row.*")


def zip_rows(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of two frames with the same place; a row without its partner stops the query."""
    out = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), keys, "full")
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    checked = F.when(same, F.lit(True)).otherwise(F.raise_error(F.lit("the sources differ in length")).cast("boolean"))
    return out.where(checked).drop("__a", "__b")


def merge_main_wins(main: DataFrame, shards: DataFrame, key: str = "idx", order: str = "ord") -> DataFrame:
    """Rows of main (its last of a key), and of the shards those with a new key (their first). Null keys go."""
    kept = _last(main.where(F.col(key).isNotNull()), key, order)
    new = _last(shards.where(F.col(key).isNotNull()), key, order, largest=False)
    return kept.unionByName(new.join(kept.select(key), key, "left_anti"))


def merge_last_wins(sources: list[DataFrame], key: str = "idx", order: str = "ord") -> DataFrame:
    """The last row of each key over the sources in their order."""
    ranked = reduce(DataFrame.unionByName, (s.withColumn("__source", F.lit(i)) for i, s in enumerate(sources)))
    return _last(ranked.where(F.col(key).isNotNull()), key, F.struct("__source", order)).drop("__source")


def apply_delta(base: DataFrame, delta: DataFrame, key: str = "idx", order: str = "ord", dropped: str = "dropped") -> DataFrame:
    """Overlay replacement rows, then remove keys whose last change is a tombstone."""
    changes = merge_last_wins([base.withColumn(dropped, F.lit(False)), delta], key, order)
    return changes.where(~F.coalesce(dropped, F.lit(False))).drop(dropped)


def pending(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs without a result, by key rather than by count, so skipped jobs can't shift the rest."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def union_in_order(sources: list[DataFrame], order: str = "ord", first: list[int | None] | None = None) -> DataFrame:
    """Concatenate with columns `source` and `ord`; optionally the first n rows of each source."""
    out = []
    for i, s in enumerate(sources):
        s = s.withColumn("source", F.lit(i))
        n = first[i] if first else None
        out.append(s if n is None else s.orderBy(order).limit(n))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def take_exactly(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows; stops the query if there are fewer."""
    return df.orderBy(order).limit(n).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.when(F.col("__n") >= n, F.lit(True)).otherwise(F.raise_error(F.lit("too few rows")).cast("boolean"))).drop("__n")


def dense_ids(df: DataFrame, order: str, name: str = "row_id") -> DataFrame:
    """Ids 0..N-1 in the order of a numeric column, without one task that holds all rows: rows are numbered inside blocks
    between approximate quantiles, so that blocks are alike whatever the values, and only the blocks' counts meet. Rows
    of one value share a block."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = df.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10 * n).alias("q")).first()["q"] if n > 1 else []
    bounds = sorted(set(bounds or []))
    block = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(order))) if bounds else F.lit(0)
    df = df.withColumn("__b", block)
    counts = df.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__b", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy(order))).join(F.broadcast(before), "__b")
    return out.withColumn(name, (F.col("__base") + F.col("__r") - 1).cast("long")).drop("__b", "__r", "__base")


def added_gold(candidates, gold):
    """Candidates with the gold one at the end if it is missing; a blank or NIL gold adds nothing."""
    usable = (F.coalesce(gold, F.lit("")) != "") & (F.upper(gold) != "NIL")
    return F.when(usable & ~F.array_contains(candidates, gold), F.array_append(candidates, gold)).otherwise(candidates)


def rewrite_candidates(df: DataFrame, seed: int = 42, key: str = "ord", most: int = 21) -> DataFrame:
    """df (question, output, candidate_count, key) with the gold answer among the candidates and these in random order.

    Added are added_gold, shuffled, parsed and over_limit (more than `most` candidates). A question whose candidates
    aren't as many as the audit row says passes unchanged; a blank or NIL gold adds nothing."""
    found = strict_candidates(F.col("question"), F.coalesce(F.col("candidate_count"), F.lit(-1)))
    out = df.withColumn("__found", found).withColumn("__gold", F.trim(F.coalesce("output", F.lit("")))).withColumn("__all", added_gold(F.col("__found"), F.col("__gold")))
    parsed = F.col("__found").isNotNull()
    n = F.size("__all")
    # The list stands between its opening and the closing question, which are kept as they are.
    whole = r"(?is)^(.*?the referent entity candidates are:\s?)(.*?)(\s?what is the correct.*)$"
    listed = F.array_join(shuffled(F.col("__all"), seed, F.col(key)), ", ")
    new = F.concat(F.regexp_extract("question", whole, 1), listed, F.regexp_extract("question", whole, 3))
    out = out.withColumn("question", F.when(parsed, new).otherwise(F.col("question")))
    out = out.withColumn("added_gold", parsed & (n > F.size("__found"))).withColumn("shuffled", parsed & (n > 1)).withColumn("parsed", parsed).withColumn("over_limit", parsed & (n > most))
    return out.drop("__found", "__gold", "__all")
