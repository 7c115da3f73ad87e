"""Training data over the predictor seam: augmentation, pair mining, regeneration, shard merges and rebuilds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions import extraction as X
from cellweave.functions import reasoning as R
from cellweave.functions.text import blank_if_null, question_candidates, short_marker, strip
from cellweave.operators import merging, quality
from cellweave.operators.predictors import predict
from cellweave.operators.sampling import balanced

Make = Callable[[], Callable[[str], str]]


def augment(samples: DataFrame, make: Make, **seam) -> DataFrame:
    """Ask a teacher for reasoning. samples has prompt and output (the gold answer); added are output_gold, output (sane
    reasoning and the predicted entity), model_content, model_pred_entity, is_correct and error."""
    said = predict(samples.withColumnRenamed("output", "output_gold"), make, **seam)
    said = said.withColumn("model_content", strip(blank_if_null(F.col("raw_prediction")))).withColumn("__p", R.split_content(F.col("model_content")))
    answer = F.when(F.col("__p.answer") != "", F.col("__p.answer")).otherwise(F.col("model_content"))
    said = said.withColumn("model_pred_entity", X.written_entity(answer)).withColumn("__gold", X.compared_form(F.col("output_gold")))
    right = F.col("error").isNull() & (F.col("__gold") != "") & (X.compared_form(F.col("model_pred_entity")) == F.col("__gold"))
    final = X.bracketed_answer(F.when(F.col("model_pred_entity") != "", F.col("model_pred_entity")).otherwise(strip(answer)))
    output = F.when(F.col("error").isNull(), R.augmented_output(F.col("__p.reasoning"), final))
    return said.withColumn("output", output).withColumn("is_correct", right).drop("raw_prediction", "__p", "__gold")


def constrained_answer(question: Column, raw: Column) -> Column:
    """Canonical form of an answer, replaced by the question's candidate of the same form."""
    return R.answer_form(R.constrained(raw, question_candidates(question)))


def mine_pairs(samples: DataFrame, student: Make, teacher: Make, pool: DataFrame, most_sentences: int = 6, most_chars: int = 900, **seam) -> DataFrame:
    """Pairs (idx, prompt, accept, reject, gold, model_prediction, source) of samples (idx, key, prompt, question, gold)
    that the student gets wrong: the reject is its answer, the accept the first right answer in the pool (key, output,
    ord), or else the teacher's if that is right; samples with neither go. Only those reach the teacher."""
    said = predict(samples, student, **seam).where(F.col("error").isNull())
    said = said.withColumn("model_prediction", constrained_answer(F.col("question"), F.col("raw_prediction"))).withColumn("__gold", R.answer_form(F.col("gold")))
    wrong = said.where((F.col("__gold") != "") & (F.col("model_prediction") != F.col("__gold"))).withColumn("reject", R.without_end(F.col("raw_prediction")))
    wrong = wrong.select("idx", "key", "prompt", "question", "gold", "model_prediction", "reject", "__gold")
    matches = wrong.join(pool, "key").where(constrained_answer(F.col("question"), F.col("output")) == F.col("__gold"))
    cached = matches.groupBy("idx").agg(F.min_by("output", "ord").alias("accept"))
    have = wrong.join(cached, "idx").withColumn("source", F.lit("pool"))
    asked = predict(wrong.join(cached.select("idx"), "idx", "left_anti"), teacher, **seam)
    taught = asked.where(F.col("error").isNull() & (constrained_answer(F.col("question"), F.col("raw_prediction")) == F.col("__gold")))
    taught = taught.withColumn("accept", F.col("raw_prediction")).withColumn("source", F.lit("teacher"))
    out = ["idx", "prompt", R.shortened_accept(F.col("accept"), most_sentences, most_chars).alias("accept"), "reject", "gold", "model_prediction", "source"]
    return have.select(*out).unionByName(taught.select(*out))


def direct_pairs(samples: DataFrame, student: Make, **seam) -> DataFrame:
    """Pairs without reasoning: the accept is the gold answer, the reject the student's wrong one, both markers short."""
    said = predict(samples, student, **seam).where(F.col("error").isNull())
    said = said.withColumn("model_prediction", constrained_answer(F.col("question"), F.col("raw_prediction")))
    wrong = said.where((R.answer_form(F.col("gold")) != "") & (F.col("model_prediction") != R.answer_form(F.col("gold"))))
    return wrong.select("idx", "prompt", short_marker(strip(F.col("gold"))).alias("accept"), R.without_end(F.col("raw_prediction")).alias("reject"), short_marker(F.col("gold")).alias("gold"), "model_prediction")


def is_incomplete(reject: Column) -> Column:
    """A rejected answer that ends before its entity."""
    return R.parse_output(reject).isNull()


def regenerate(rows: DataFrame, student: Make, tokens: int, **seam) -> DataFrame:
    """Ask again for rejects that are incomplete (rows: idx, prompt, question, gold, reject, model_prediction). One that
    is right now is dropped, one still wrong replaces the old; rows whose new answer failed stay as they are."""
    asked = predict(rows.where(is_incomplete(F.col("reject"))), student, **seam).where(F.col("error").isNull())
    asked = asked.withColumn("__new", R.without_end(F.col("raw_prediction"))).withColumn("__pred", constrained_answer(F.col("question"), F.col("__new")))
    gold = R.answer_form(F.col("gold"))
    delta = asked.withColumn("dropped", (gold != "") & (F.col("__pred") == gold)).withColumn("reject_before_regen", F.col("reject"))
    delta = delta.withColumn("reject", F.col("__new")).withColumn("model_prediction", F.col("__pred")).withColumn("reject_regenerated_max_new_tokens", F.lit(tokens))
    columns = [*rows.columns, "reject_before_regen", "reject_regenerated_max_new_tokens", "ord"]
    none = {"reject_before_regen": F.lit(None).cast("string"), "reject_regenerated_max_new_tokens": F.lit(None).cast("int")}
    base = rows.withColumns(none).withColumn("ord", F.lit(0)).select(columns)
    return merging.apply_delta(base, delta.withColumn("ord", F.lit(1)).select(*columns, "dropped"), "idx").drop("ord")


def counters(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows there are, and how many meet each condition (sums over all ranks, so to speak)."""
    return df.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def merge_report(main: DataFrame, shards: DataFrame, key: str = "idx", order: str = "ord") -> DataFrame:
    """Counts of a main-wins merge: rows without a key, rows taken from main and from shards, and rows passed over."""
    side = lambda df, name: df.agg(F.count_if(F.col(key).isNull()).alias(f"{name}_without_key"), F.count_if(F.col(key).isNotNull()).alias(f"{name}_rows"))
    kept = merging.merge_main_wins(main.withColumn("__from", F.lit("main")), shards.withColumn("__from", F.lit("shards")), key, order)
    n = kept.agg(F.count_if(F.col("__from") == "main").alias("from_main"), F.count_if(F.col("__from") == "shards").alias("from_shards"))
    return side(main, "main").join(side(shards, "shards")).join(n)


def rebuilt_shards(samples: DataFrame, done: DataFrame, ranks: int, size: Column, key: str = "idx") -> DataFrame:
    """samples' keys with the rank that a balanced split gives them, and whether a finished row is there for it."""
    placed = balanced(samples, size, ranks, key).select(key, "worker")
    return placed.join(done.select(key).distinct().withColumn("__done", F.lit(True)), key, "left").select(key, F.col("worker").alias("rank"), F.coalesce("__done", F.lit(False)).alias("is_done"))


def boundary_mismatches(df: DataFrame, make_tokenizer: Callable[[], Callable[[str], list[int]]], prompt: str = "prompt", completions: tuple[str, ...] = ("chosen", "rejected")) -> DataFrame:
    """df with boundary_ok: a prompt's tokens are the first tokens of the prompt with each of its completions. Where
    they aren't, cutting at the prompt's length would lose characters of the completion."""
    schema = T.StructType([*df.schema.fields, T.StructField("boundary_ok", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_tokenizer()
        for batch in batches:
            ok = []
            for row in batch[[prompt, *completions]].itertuples(index=False):
                own = encode(row[0] or "")
                ok.append(all(encode((row[0] or "") + (c or ""))[: len(own)] == own for c in row[1:]))
            yield batch.assign(boundary_ok=ok)

    return df.mapInPandas(run, schema)


def funnel_three_steps(rows: DataFrame, tokens_over: int, target_tokens: int) -> DataFrame:
    """rows (idx, accept, reject, gold) with step (kept, compressed, or why they go): structure, then the low-information
    score of the accept, then its length, where long ones are compressed or go; accept is the compressed text."""
    parsed = R.parse_output(F.col("accept"))
    mismatch = (strip(blank_if_null(F.col("gold"))) != "") & (R.marker_form(parsed["entity"]) != R.marker_form(strip(F.col("gold"))))
    first = F.when(parsed.isNull(), "accept_unparsable").when(mismatch, "gold_mismatch").when(F.coalesce(R.is_collapsed(F.col("reject")), F.lit(False)), "reject_format_collapse")
    judged = quality.low_info(rows.withColumn("first_step", first), "accept")
    long = R.estimated_tokens(F.col("accept")) > tokens_over
    packed = quality.compress(judged, "accept", target_tokens)
    step = F.coalesce("first_step", F.when(F.col("tag") != "keep", F.col("tag")), F.when(long & ~F.col("ok"), F.concat(F.lit("compress_failed:"), "reason")), F.when(long, F.lit("compressed")), F.lit("kept"))
    packed = packed.withColumn("step", step).withColumn("accept", F.when(F.col("step") == "compressed", F.col("compressed")).otherwise(F.col("accept")))
    return packed.select(*rows.columns, "step", "before_tokens", "after_tokens")



def evaluate(samples: DataFrame, make: Make, done: DataFrame | None = None, **seam) -> DataFrame:
    """samples (idx, prompt, question, gold) with raw_prediction, prediction, correct (0 or 1), has_think and error. Rows
    whose idx is in `done` aren't asked again; those results are to be merged in."""
    todo = samples if done is None else merging.pending(samples, done, "idx")
    said = predict(todo, make, **seam)
    said = said.withColumn("prediction", constrained_answer(F.col("question"), F.col("raw_prediction")))
    right = F.col("error").isNull() & (F.col("prediction") == R.answer_form(F.col("gold")))
    return said.withColumn("correct", F.coalesce(right, F.lit(False)).cast("long")).withColumn("has_think", F.coalesce(R.has_think(F.col("raw_prediction")), F.lit(False)))
