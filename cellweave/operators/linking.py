"""Entity linking end to end: retrieval by three ways, features, scores, audit rows, gold answers, remote rankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import scoring
from cellweave.functions.text import blank_if_null, candidate_text, collapse, is_blank, name_variants, tokens
from cellweave.operators.retrieval import exact, full_text, merged, prefix, scale_bm25, top

DEFAULT_TYPE = "owl#Thing"


def link(jobs: DataFrame, kb: DataFrame, priors: DataFrame, top_k: int = 20, use_prefix: bool = True, use_full_text: bool = True, exact_limit: int = 80, prefix_limit: int = 80, text_limit: int = 120, most_entities: int = 260) -> DataFrame:
    """Ranked candidates (mention_norm, column_norm, context_norm, qid, place, score, rank and the features) of the
    distinct (mention_norm, column_norm, context_norm) of jobs.

    kb has qid, ord, norm, description_norm, type_norm and body (what full text looks in); priors has mention_norm,
    qid, prior. Entities come in the order exact, prefix, full text, the first place of an entity counts, and most_entities
    are scored; ties of the score keep that order. What depends on the mention alone is computed once per mention.
    """
    asked = jobs.where(F.col("mention_norm") != "").select("mention_norm", "column_norm", "context_norm").distinct()
    mentions = asked.select("mention_norm").distinct()
    aliases = kb.select(F.col("norm").alias("alias_norm"), "qid", "ord")
    sources = [exact(mentions, aliases, exact_limit)]
    if use_prefix:
        sources.append(prefix(mentions, aliases, prefix_limit))
    ranked = [s.withColumn("bm25", F.lit(None).cast("double")) for s in sources]
    if use_full_text:
        ranked.append(scale_bm25(full_text(mentions, kb, "qid", "body", text_limit)).select("mention_norm", "qid", "rank", "bm25"))
    placed = top(merged(*ranked), ["mention_norm"], [F.col("place")], most_entities, "nth").drop("place")
    pairs = placed.join(kb, "qid").join(priors.select("mention_norm", "qid", "prior"), ["mention_norm", "qid"], "left")
    m, label = F.col("mention_norm"), F.col("norm")
    own = lambda c: F.array_distinct(tokens(F.col(c)))
    of_mention = {"exact": (label == m).cast("double"), "contains": F.contains(label, m).cast("double"), "sim": scoring.similarity(m, label), "prior": F.coalesce("prior", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))}
    pairs = pairs.select("mention_norm", "qid", "nth", own("description_norm").alias("__description"), "type_norm", *(c.alias(k) for k, c in of_mention.items()))
    pairs = asked.withColumn("__context", own("context_norm")).join(pairs, "mention_norm").withColumn("type", scoring.type_match(F.col("column_norm"), F.col("type_norm")))
    pairs = pairs.withColumn("ctx", scoring.jaccard(F.col("__description"), F.col("__context")))
    scored = pairs.withColumn("score", F.round(scoring.candidate_score({k: F.col(k) for k in scoring.WEIGHTS}), 6))
    best = top(scored, ["mention_norm", "column_norm", "context_norm"], [F.col("score").desc(), F.col("nth")], top_k)
    return best.select("mention_norm", "column_norm", "context_norm", "qid", F.col("nth").alias("place"), "score", F.col("rank").cast("long").alias("rank"), *scoring.WEIGHTS)


def audit(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """jobs with candidate_qids in rank order, gold_in_topk and candidate_count; a job without candidates has none."""
    by = ["mention_norm", "column_norm", "context_norm"]
    lists = candidates.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qid"))), lambda s: s["qid"]).alias("candidate_qids"))
    out = jobs.join(lists, by, "left").withColumn("candidate_qids", F.coalesce("candidate_qids", F.array().cast("array<string>")))
    return out.withColumn("gold_in_topk", F.array_contains("candidate_qids", blank_if_null(F.col("gold_qid")))).withColumn("candidate_count", F.size("candidate_qids").cast("long"))


def gold_output(jobs: DataFrame, kb: DataFrame) -> DataFrame:
    """jobs with output: the gold entity's candidate text, else its title's, else the mention's."""
    texts = kb.select(F.col("qid").alias("gold_qid"), candidate_text(F.col("label"), F.col("qid"), F.col("description"), F.col("p31_label")).alias("__text"))
    title = F.trim(F.replace(blank_if_null(F.col("gold_wiki_title")), F.lit("_"), F.lit(" ")))
    bare = lambda name: F.concat(F.lit("<"), name, F.lit(" [DESCRIPTION] None [TYPE] None>"))
    keyed = jobs.withColumn("__job_qid", F.col("gold_qid")).withColumn("gold_qid", F.trim(blank_if_null(F.col("gold_qid"))))
    out = keyed.join(texts, "gold_qid", "left").withColumn("gold_qid", F.col("__job_qid"))
    return out.withColumn("output", F.coalesce("__text", F.when(title != "", bare(title)).otherwise(bare(blank_if_null(F.col("mention")))))).drop("__text", "__job_qid")


def lookup(requests: DataFrame, kb: DataFrame) -> DataFrame:
    """Entities of a request list (request, qid, ord): one row per request and distinct entity that is there, with
    place, its place in the order asked for."""
    first = requests.groupBy("request", "qid").agg(F.min("ord").alias("ord")).join(kb, "qid")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("ord")).cast("long")).drop("ord")


def with_table(jobs: DataFrame, tables: DataFrame, key: str = "source_path") -> DataFrame:
    """Jobs beside the table they are from; a table is read once however many jobs it has. Jobs without one go."""
    return jobs.join(tables, key)


def statement_counts(statements: DataFrame, subject: str) -> DataFrame:
    """(uri, statement_count) of the subjects that have statements."""
    return statements.groupBy(F.col(subject).alias("uri")).agg(F.count(F.lit(1)).alias("statement_count"))


def with_statement_counts(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates with statement_count (0 where there is none) and the rank_score that it changes."""
    out = candidates.join(counts, "uri", "left").withColumn("statement_count", F.coalesce("statement_count", F.lit(0)))
    score = scoring.remote_rank(collapse(F.lower("label")), collapse(F.lower("mention")), F.col("score"), F.col("sitelinks"), F.col("statement_count"), F.col("is_disambiguation"))
    return out.withColumn("rank_score", F.round(score, 6))


def graph_candidates(mentions: DataFrame, graph: DataFrame, counts: DataFrame, limit: int = 20, fetch_limit: int = 120) -> DataFrame:
    """Candidates of mentions by a graph store's two queries, run as joins: labels equal to a case variant of the mention,
    and labels in the range that a variant begins. Variants are asked in turn until max(2 * limit, 40) candidates
    are there. The best row of an entity counts; statement counts then change the scores.

    graph has uri, entity_id, label, score, sitelinks, is_disambiguation and ord, the order in which the store answers.
    """
    asked = mentions.select(F.trim("mention").alias("mention")).where(F.col("mention") != "").distinct()
    variants = asked.select("mention", F.posexplode(name_variants(F.col("mention"))).alias("turn", "variant"))
    row = ["uri", "entity_id", "label", "score", "sitelinks", "is_disambiguation"]
    exact_most = max(fetch_limit * 8, 1000)
    same = top(variants.join(graph, F.col("variant") == F.col("label")), ["mention"], [F.col("ord"), F.col("entity_id")], exact_most)
    # The first two characters make the range an equi-join; a variant has at least two.
    usable = variants.where(F.length("variant") >= 2).withColumn("__k", F.left("variant", F.lit(2)))
    keyed = graph.withColumn("__k", F.left("label", F.lit(2)))
    ranged = usable.join(keyed, "__k").where(F.startswith("label", F.col("variant")))
    ranged = top(ranged, ["mention", "turn"], [F.col("ord"), F.col("entity_id")], max(fetch_limit, 4 * limit))
    n_same = same.groupBy("mention").agg(F.count(F.lit(1)).alias("__same"))
    per_turn = usable.select("mention", "turn").join(ranged.groupBy("mention", "turn").agg(F.count(F.lit(1)).alias("__n")), ["mention", "turn"], "left").join(n_same, "mention", "left")
    upto = Window.partitionBy("mention").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.coalesce("__n", F.lit(0))).over(upto), F.lit(0))
    # The first turn is always taken; a later one if what came before it falls short.
    taken = per_turn.withColumn("__before", before).withColumn("__first", F.row_number().over(Window.partitionBy("mention").orderBy("turn")) == 1)
    taken = taken.where(F.col("__first") | (F.coalesce("__same", F.lit(0)) + F.col("__before") < max(2 * limit, 40))).select("mention", "turn")
    collected = same.select("mention", *row).unionByName(ranged.join(taken, ["mention", "turn"]).select("mention", *row))
    once = collected.dropDuplicates(["mention", "entity_id", "label", "score", "sitelinks"])
    early = with_statement_counts(once, counts.limit(0)).drop("statement_count")
    best = top(early, ["mention", "entity_id"], [F.col("rank_score").desc(), F.col("label")], 1, "__r").drop("__r", "rank_score")
    order = [F.col("rank_score").desc(), F.col("statement_count").desc(), F.col("score").desc(), F.col("sitelinks").desc(), F.length("label"), F.col("entity_id")]
    out = top(with_statement_counts(best, counts), ["mention"], order, max(1, limit))
    return out.select("mention", "entity_id", "uri", "label", "statement_count", "rank_score", F.col("rank").cast("long").alias("rank"))


def typed_candidates(items: DataFrame, details: DataFrame, labels: DataFrame, by: str = "mention", limit: int = 20) -> DataFrame:
    """Candidate texts of a search service's items (by, ord, qid, label, description), whose types come from details
    (qid, p31) and labels (p31, type_label), each asked once per distinct id; a missing type reads owl#Thing, a missing
    description stays empty. (by, rank, candidate)"""
    kept = top(items.where(F.startswith("qid", F.lit("Q"))), [by], [F.col("ord")], max(1, min(limit, 20)))
    types = details.where(~is_blank(F.col("p31"))).select("qid", "p31").join(labels.where(~is_blank(F.col("type_label"))), "p31").select("qid", "type_label")
    out = kept.join(types, "qid", "left")
    name = F.when(is_blank(F.col("label")), F.col("qid")).otherwise(F.col("label"))
    text = F.concat(F.lit("<"), name, F.lit(" [DESCRIPTION] "), blank_if_null(F.col("description")), F.lit(" [TYPE] "), F.coalesce("type_label", F.lit(DEFAULT_TYPE)), F.lit(">"))
    return out.select(by, F.col("rank").cast("long").alias("rank"), text.alias("candidate"))


def in_range(label: Column, start: str) -> Column:
    """Whether a label is in the range from `start` to the last string that begins with it."""
    return (label >= start) & (label < start + "\uffff")
