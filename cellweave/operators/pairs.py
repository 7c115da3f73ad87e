"""Preference pairs: mining, validation, length filters, the drop funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.functions.scoring import length_ratio
from cellweave.functions.text import is_blank


def wrong_predictions(df: DataFrame, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    return df.where((F.coalesce(F.col(gold), F.lit("")) != "") & (F.coalesce(F.col(prediction), F.lit("")) != F.col(gold)))


def pool_key(instruction: Column, input_seg: Column, question: Column) -> Column:
    return F.concat_ws("␟", *(F.coalesce(c, F.lit("")) for c in (instruction, input_seg, question)))


def reference_output(jobs: DataFrame, pool: DataFrame, key: str = "key", gold: str = "gold") -> DataFrame:
    """The first pool output of a job's key whose answer is the gold one; jobs without any keep a null.

    Answers are taken once per row and meet by their SHA-256, so a key's jobs never meet all of its pool; the pool's texts
    move once, by that digest, and a job's row only when it has found its text."""
    form = lambda c: F.sha2(R.answer_form(F.col(c)), 256)
    best = pool.select(key, form("output").alias("__answer"), "output", "ord").groupBy(key, "__answer").agg(F.min_by("output", "ord").alias("accept"))
    return jobs.withColumn("__answer", F.when(F.col(gold).isNotNull(), form(gold))).join(best, [key, "__answer"], "left").drop("__answer")


def collapse_reason(accept: Column, reject: Column) -> Column:
    return F.when(is_blank(accept) | is_blank(reject), "missing_field").when(R.is_collapsed(reject), "collapsed").when(R.parse_output(accept).isNull(), "unparsable")


def align(pairs: DataFrame) -> DataFrame:
    """Pairs whose chosen answer starts with '<'; the rejected one is cut to its first '<', and the '<' that both then
    start with moves to the prompt."""
    chosen, rejected = F.ltrim("accept"), F.regexp_extract("reject", r"(?s)(<.*)$", 1)
    fit = pairs.where(F.startswith(chosen, F.lit("<")) & (rejected != ""))
    return fit.withColumn("prompt", F.concat("prompt", F.lit("<"))).withColumn("accept", F.substr(chosen, F.lit(2))).withColumn("reject", F.substr(rejected, F.lit(2)))


def funnel(pairs: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """drop_reason: the first step whose condition holds, null for pairs that stay. One pass for all counts."""
    reason = F.lit(None).cast("string")
    for name, drops in reversed(steps):
        reason = F.when(drops, F.lit(name)).otherwise(reason)
    return pairs.withColumn("drop_reason", reason)


def length_filters(n_prompt: Column, n_chosen: Column, n_rejected: Column, most: int, ratio: float) -> list[tuple[str, Column]]:
    return [("too_long", n_prompt + F.greatest(n_chosen, n_rejected) > most), ("ratio", length_ratio(n_chosen, n_rejected) > ratio)]


def by_correctness(df: DataFrame, path: str) -> None:
    """Write correct and wrong rows to folders of their own."""
    df.withColumn("is_correct", F.col("correct") == 1).write.partitionBy("is_correct").json(path)


def first_text(*fields: Column) -> Column:
    """The first field that is a string, an empty one included; empty if none is."""
    return F.coalesce(*fields, F.lit(""))


def has_reasoning(*fields: Column) -> Column:
    """Whether the first string of the fields has a think block that isn't empty."""
    return F.coalesce(R.think_of(first_text(*fields)) != "", F.lit(False))


def training_lengths(n_prompt: Column, n_output: Column, most: int, most_output: int) -> list[tuple[str, Column]]:
    """Funnel steps for supervised samples: too long, nothing left to learn after the cut, or too long an answer."""
    return [("all_masked", n_prompt >= most), ("too_long", n_prompt + n_output > most), ("output_too_long", n_output > most_output)]


def wrong_lines(df: DataFrame, order: str = "ord", raw: str = "raw_prediction") -> DataFrame:
    """Places of rows that are wrong, and of those whose raw text never closes its reasoning."""
    return df.select(F.col(order), (F.col("correct") == 0).alias("wrong"), (~F.contains(F.coalesce(F.col(raw), F.lit("")), F.lit("</think>"))).alias("unclosed")).where(F.col("wrong") | F.col("unclosed"))
