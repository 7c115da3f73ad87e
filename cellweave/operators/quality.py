"""Quality of reasoning: the low-information score, extractive compression, and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.functions.text import blank_if_null, is_blank, lower_collapse


def low_info(df: DataFrame, output: str, think_min_chars: int = 80, threshold: int = 3) -> DataFrame:
    """df with score, tag (keep, low_info, hard_drop) and reasons."""
    whole = blank_if_null(F.col(output))
    d = df.withColumn("__think", R.think_of(whole)).withColumn("__has", F.col("__think").isNotNull()).withColumn("__think", F.coalesce("__think", F.lit("")))
    think = F.col("__think")
    lists = {"template": R.TEMPLATE, "evidence": R.EVIDENCE, "justify": R.JUSTIFY, "contrast": R.CONTRAST, "leakage": R.LEAKAGE, "ramble": R.RAMBLE}
    d = d.select("*", *(R.hits(think, p).alias(f"__{k}") for k, p in lists.items()), R.hits(whole, R.REFUSAL).alias("__refusal"), F.length(think).alias("__chars"))
    n = {k: F.col(f"__{k}") for k in (*lists, "refusal", "chars")}
    markers = F.size(F.regexp_extract_all(think, F.lit(r"(?i)\[\s*desc"), F.lit(0)))
    cue = F.regexp_extract(think, rf"(?isu)^.*({R.CONCLUSION}.*)$", 1)
    concluded = F.regexp_extract(cue, R.ENTITY, 0)
    in_answer, anywhere = F.regexp_extract(R.after_think(whole), R.ENTITY, 0), R.entities(whole)
    final = F.when(F.col("__has") & (in_answer != ""), in_answer).otherwise(F.coalesce(F.when(F.size(anywhere) > 0, F.element_at(anywhere, -1)), F.lit("")))
    other = (final != "") & (concluded != "") & (lower_collapse(final) != lower_collapse(concluded))
    grounded, justified = n["evidence"] >= 1, (n["justify"] >= 1) | (n["contrast"] >= 1)
    one = F.lit(1)
    rules = [
        (~grounded, F.lit(3), "no_evidence_terms"),
        (~justified, F.lit(3), "no_justification"),
        (n["chars"] < think_min_chars, F.lit(2), f"short_think<{think_min_chars}"),
        (n["template"] > 0, F.least(F.lit(4), 1 + n["template"]), "template_phrases"),
        (markers >= 3, 2 + (markers >= 5).cast("int"), "copies_candidate_list"),
        (n["leakage"] > 0, F.least(F.lit(2), n["leakage"]), "answer_leakage"),
        (n["ramble"] >= 2, 2 + (n["ramble"] >= 4).cast("int"), "rambling"),
        (other, F.lit(4), "answer_inconsistent"),
        (grounded & justified, F.lit(-2), "grounded_and_justified"),
        (n["contrast"] > 0, -F.least(F.lit(3), one + n["contrast"]), "has_contrast"),
        (n["evidence"] >= 3, F.lit(-1), "rich_evidence"),
    ]
    score = sum((F.when(c, p).otherwise(0) for c, p, _ in rules), F.lit(0))
    hard = ~F.col("__has") | (n["chars"] == 0) | (n["refusal"] > 0) | ((n["chars"] < 40) & ~grounded) | ((n["template"] > 0) & ~grounded & (n["contrast"] == 0))
    d = d.withColumn("score", score).withColumn("reasons", F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, _, r in rules))))
    d = d.withColumn("tag", F.when(hard, "hard_drop").when(F.col("score") >= threshold, "low_info").otherwise("keep"))
    return d.drop(*(c for c in d.columns if c.startswith("__")))


def kept(df: DataFrame, mode: str = "all") -> DataFrame:
    """mode "hard" drops hard drops only, "all" keeps what is tagged keep."""
    return df.where(F.col("tag") != "hard_drop" if mode == "hard" else F.col("tag") == "keep")


def reason_counts(df: DataFrame, most: int = 20) -> DataFrame:
    """The commonest reasons."""
    # explode would imply a filter on the reasons, below which they would be computed once more.
    counts = df.select(F.explode_outer("reasons").alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "reason").limit(most)


def compress(df: DataFrame, output: str, target_tokens: int, min_sentences: int = 1, drop_final: bool = True, ngram: int = 8, most_repeats: float = 0.3) -> DataFrame:
    """df with compressed, ok, reason, before_tokens, after_tokens. Sentences are taken by evidence, then place, while
    their words fit the budget; the counter is additive over words, so the running total is one number."""
    whole = blank_if_null(F.col(output))
    d = df.withColumn("__p", R.parse_output(whole)).withColumn("before_tokens", R.estimated_tokens(whole))
    budget = F.greatest(F.lit(16), F.lit(target_tokens) - R.estimated_tokens(R.build_output(F.lit(""), F.col("__p.entity"))) - 8)
    d = d.withColumn("__budget", budget).withColumn("__all", R.sentences(F.col("__p.think")))
    pool = F.filter("__all", lambda s: ~R.is_dump(s) & ~(R.is_final_line(s) & F.lit(drop_final)))
    d = d.withColumn("__pool", R.distinct_sentences(pool))
    fallback = R.distinct_sentences(F.col("__all"))
    fallback = F.when(F.size(fallback) > 0, fallback).otherwise(F.array(F.col("__p.think")))
    real = F.size("__pool") > 0
    d = d.withColumn("__ranked", F.when(real, F.col("__pool")).otherwise(fallback)).withColumn("__real", real)
    n_words = lambda s: F.size(F.filter(F.split(s, r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))
    weigh = lambda s, i: F.struct(F.when(F.col("__real"), -R.hits(s, R.SENTENCE_EVIDENCE)).otherwise(0).alias("e"), i.alias("i"), n_words(s).alias("w"))
    d = d.withColumn("__order", F.array_sort(F.transform("__ranked", weigh)))
    tokens_of = lambda w: F.when(w == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(w * 1.3).cast("int")))
    begin = F.struct(F.lit(0).alias("w"), F.array().cast("array<int>").alias("at"), F.lit(False).alias("full"))

    def step(acc: Column, s: Column) -> Column:
        fits = ~acc["full"] & ((tokens_of(acc["w"] + s["w"]) <= F.col("__budget")) | (F.size(acc["at"]) == 0))
        w = F.when(fits, acc["w"] + s["w"]).otherwise(acc["w"])
        at = F.when(fits, F.array_append(acc["at"], s["i"])).otherwise(acc["at"])
        return F.struct(w.alias("w"), at.alias("at"), (acc["full"] | ((F.size(at) >= min_sentences) & (tokens_of(w) >= F.col("__budget")))).alias("full"))

    d = d.withColumn("__at", F.array_sort(F.aggregate("__order", begin, step, lambda a: a["at"])))
    d = d.withColumn("__text", F.array_join(F.transform("__at", lambda i: F.get("__ranked", i)), " "))
    d = d.withColumn("__text", F.when(R.estimated_tokens(F.col("__text")) > F.col("__budget"), R.first_tokens(F.col("__text"), F.col("__budget"))).otherwise(F.col("__text")))
    d = d.withColumn("__new", R.build_output(F.col("__text"), F.col("__p.entity"))).withColumn("__again", R.parse_output(F.col("__new"))).withColumn("__n", R.estimated_tokens(F.col("__new")))
    reason = (
        F.when(F.col("__p").isNull(), "unparsable").when(F.col("__again").isNull(), "rebuild_malformed")
        .when(R.marker_form(F.col("__again.entity")) != R.marker_form(F.col("__p.entity")), "entity_changed").when(is_blank(F.col("__text")), "empty_reasoning")
        .when(F.col("__n") > target_tokens, "still_too_long").when(R.repeat_ratio(F.col("__text"), ngram) > most_repeats, "repetitive").otherwise("ok")
    )
    d = d.withColumn("reason", reason).withColumn("ok", F.col("reason") == "ok")
    d = d.withColumn("compressed", F.when(F.col("ok"), F.col("__new")).otherwise(whole)).withColumn("after_tokens", F.when(F.col("reason") == "unparsable", F.col("before_tokens")).otherwise(F.col("__n")))
    return d.drop(*(c for c in d.columns if c.startswith("__")))


def compression_report(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("before_tokens"), 1).alias("avg_before"), F.round(F.avg("after_tokens"), 1).alias("avg_after"))
