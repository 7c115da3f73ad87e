"""Metrics of predictions and rankings, and the leaderboard of checkpoints."""

from __future__ import annotations

from math import exp, lgamma, log

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cellweave.functions import reasoning as R
from cellweave.functions.text import let


def accuracy(df: DataFrame, by: list[str] | None = None, gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """Exact-match accuracy (equal to its F1), 0 for no rows."""
    right = F.count_if(F.col(gold) == F.col(prediction))
    total = F.count(F.lit(1))
    return df.groupBy(*(by or [])).agg(right.alias("n_correct"), total.alias("n_total"), F.when(total == 0, 0.0).otherwise(F.round(right / total, 6)).alias("accuracy"))


def precision_at(relevance: Column, k: int) -> Column:
    """Share of hits among the first k; stops the query if the list is shorter."""
    hits = F.size(F.filter(F.slice(relevance, 1, k), lambda r: r != 0)) / k
    return F.when(F.size(relevance) >= k, hits).otherwise(F.raise_error(F.lit("the list is shorter than k")).cast("double"))


def mean_average_precision(df: DataFrame, relevance: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the average precision of ranked lists."""
    return df.groupBy(*(by or [])).agg(F.avg(average_precision(F.col(relevance))).alias("map"))


def average_precision(relevance: Column) -> Column:
    """Mean of the precision at each hit, 0 without hits."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("hits"), F.lit(0.0).alias("sum"))

    def step(acc: Column, r: Column) -> Column:
        n, hits = acc["n"] + 1, acc["hits"] + (r != 0).cast("int")
        return F.struct(n.alias("n"), hits.alias("hits"), (acc["sum"] + F.when(r != 0, hits / n).otherwise(0.0)).alias("sum"))

    return F.aggregate(relevance, begin, step, lambda a: F.when(a["hits"] == 0, 0.0).otherwise(a["sum"] / a["hits"]))


def set_scores(gold: Column, pred: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of two arrays as sets."""
    common = F.size(F.array_intersect(gold, pred))
    n_g, n_p = F.size(F.array_distinct(gold)), F.size(F.array_distinct(pred))
    p, r = F.when(n_p == 0, 0.0).otherwise(common / n_p), F.when(n_g == 0, 0.0).otherwise(common / n_g)
    return p, r, F.when(p + r == 0, 0.0).otherwise(2 * p * r / (p + r))


def macro_f1(df: DataFrame, gold: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Mean of the F1 of two arrays as sets, 0 for no rows."""
    f1 = set_scores(F.col(gold), F.col(pred))[2]
    return df.groupBy(*(by or [])).agg(F.coalesce(F.avg(f1), F.lit(0.0)).alias("macro_f1"))


def f1_score(df: DataFrame, average: str = "micro", gold: str = "gold", prediction: str = "prediction") -> DataFrame:
    """F1 of one prediction a row, which is the accuracy; averages other than micro and binary have no meaning here."""
    if average not in ("micro", "binary"):
        raise ValueError("average must be micro or binary")
    return accuracy(df, None, gold, prediction).select(F.col("accuracy").alias("f1"))


def nearest_rank(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """The value at place round(p * (n - 1)) of the sorted values, halves to even. Equal values are counted first, so
    what is sorted is distinct values."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy(value)
    ranked = counts.withColumn("__hi", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    place = lambda p: F.bround(F.lit(p) * (F.col("__all") - 1), 0).cast("long")
    at = [F.max(F.when((F.col("__hi") - F.col("__n") <= place(p)) & (place(p) < F.col("__hi")), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return ranked.groupBy(*by).agg(*at)


@pandas_udf(T.DoubleType())
def mcnemar(broken: pd.Series, fixed: pd.Series) -> pd.Series:
    """Two-sided exact test of paired changes."""

    def p(b: int, c: int) -> float:
        n, least = b + c, min(b, c)
        if not n:
            return 1.0
        # Binomial terms from the largest down; each is a falling part of the one before, so few of them count.
        term = exp(lgamma(n + 1) - lgamma(least + 1) - lgamma(n - least + 1) - n * log(2))
        total, i = term, least
        while i and term > 1e-18 * total:
            term *= i / (n - i + 1)
            total += term
            i -= 1
        return min(1.0, 2 * total)

    return pd.Series([p(int(b), int(c)) for b, c in zip(broken, fixed, strict=True)])


def paired_changes(df: DataFrame, before: str, after: str) -> DataFrame:
    """How many rows a change fixed and broke, with the test's probability."""
    n = df.agg(F.count_if((F.col(before) == 0) & (F.col(after) == 1)).alias("fixed"), F.count_if((F.col(before) == 1) & (F.col(after) == 0)).alias("broken"), F.count(F.lit(1)).alias("n"))
    return n.withColumn("p_value", mcnemar("broken", "fixed"))


def outside_candidates(df: DataFrame, prediction: str, candidates: str) -> DataFrame:
    """Rows whose prediction is none of the candidates, in canonical form."""
    same = let(R.answer_form(F.col(prediction)), lambda form: F.exists(candidates, lambda c: R.answer_form(c) == form))
    return df.where(~same)


def checkpoint_score(acc: Column, has_think: Column | None = None) -> Column:
    score = F.coalesce(acc, F.lit(-1.0))
    return score if has_think is None else score + F.coalesce(has_think, F.lit(0.0))


def leaderboard(df: DataFrame, k: int, score: str = "score", step: str = "step", later_wins: bool = False) -> DataFrame:
    """The k best steps; of equal scores the earlier step, or the later one if asked."""
    return df.orderBy(F.col(score).desc(), F.col(step).desc() if later_wins else F.col(step)).limit(k)


def running_best(df: DataFrame, by: str, score: str = "score", step: str = "step") -> DataFrame:
    """At every step the best score so far, and whether this step set it."""
    upto = Window.partitionBy(by).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(score).over(upto)
    return df.withColumn("best", F.greatest(F.col(score), F.coalesce(before, F.col(score)))).withColumn("is_best", before.isNull() | (F.col(score) > before))
