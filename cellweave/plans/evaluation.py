"""Metrics over labels and predictions derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import reasoning, text
from cellweave.operators import metrics, pairs
from cellweave.plans.registry import query, table


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return lb.join(d, "doc_id").select("doc_id", "lang", F.col("quality").cast("string").alias("gold"), (F.col("n_chars") > 1000).cast("int").cast("string").alias("prediction"), "toxic")


_PRED = "p AS (SELECT l.doc_id, lang, CAST(quality AS VARCHAR) AS gold, CAST(CAST(n_chars > 1000 AS INT) AS VARCHAR) AS prediction, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


@query(f"WITH {_PRED} SELECT lang, count(*) FILTER (gold = prediction) AS n_correct, count(*) AS n_total, round(avg(CAST(gold = prediction AS INT)), 6) AS accuracy FROM p GROUP BY 1")
def a11_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.accuracy(predictions(spark, sf_dir), ["lang"])


@query(f"WITH {_PRED} SELECT doc_id, gold, prediction FROM p WHERE gold <> '' AND gold <> prediction")
def p22_wrong_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.wrong_predictions(predictions(spark, sf_dir)).select("doc_id", "gold", "prediction")


@query("""WITH l AS (SELECT doc_id // 20 AS q, list(quality ORDER BY doc_id) AS rel FROM labels GROUP BY 1),
h AS (SELECT q, rel, unnest(rel) AS r, unnest(range(1, len(rel) + 1)) AS n FROM l), c AS (SELECT q, r, n, sum(r) OVER (PARTITION BY q ORDER BY n) AS hits FROM h)
SELECT q, round(coalesce(sum(hits / n) FILTER (r = 1) / sum(r), 0), 6) AS average_precision, CAST(sum(r) FILTER (n = 1) AS DOUBLE) AS p_at_1 FROM c GROUP BY 1""")
def a13_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 20).alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda s: s["quality"]).alias("rel"))
    return rel.select("q", F.round(metrics.average_precision(F.col("rel")), 6).alias("average_precision"), metrics.precision_at(F.col("rel"), 1).alias("p_at_1"))


@query("""WITH h AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), w AS (SELECT doc_id, list_distinct(w[:len(w) * 2 // 3]) AS g, list_distinct(w[len(w) // 3 + 1:]) AS p FROM h),
s AS (SELECT doc_id, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(p) END AS pr, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(g) END AS re FROM w)
SELECT doc_id, round(pr, 6) AS prec, round(re, 6) AS rec, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS f1 FROM s""")
def a14_set_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first against the last two thirds of each text's words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.lower("text"), " ").alias("w"))
    n = F.size("w")
    third = F.floor(n / 3).cast("int")
    d = d.select("doc_id", F.slice("w", 1, F.floor(n * 2 / 3).cast("int")).alias("g"), F.slice("w", third + 1, n - third).alias("p"))
    scores = metrics.set_scores(F.col("g"), F.col("p"))
    return d.select("doc_id", *(F.round(s, 6).alias(n) for s, n in zip(scores, ("prec", "rec", "f1"), strict=True)))


@query(f"""WITH {_PRED}, x AS (SELECT CAST(gold = prediction AS INT) AS b, 1 - toxic AS a FROM p), c AS (SELECT count(*) FILTER (b = 0 AND a = 1) AS fixed, count(*) FILTER (b = 1 AND a = 0) AS broken, count(*) AS n FROM x),
k AS (SELECT fixed, broken, n, unnest(range(least(fixed, broken) + 1)) AS i FROM c)
SELECT fixed, broken, any_value(n) AS n, round(least(1.0, 2 * sum(exp(lgamma(fixed + broken + 1) - lgamma(i + 1) - lgamma(fixed + broken - i + 1) - (fixed + broken) * ln(2)))), 9) AS p_value FROM k GROUP BY fixed, broken""")
def a19_paired_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir).select((F.col("gold") == F.col("prediction")).cast("int").alias("b"), (1 - F.col("toxic")).alias("a"))
    return metrics.paired_changes(p, "b", "a").withColumn("p_value", F.round("p_value", 9))


_NAME = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"
_SHAPES = f"""n AS (SELECT doc_id, trim({_NAME}) AS name, lang, source FROM documents WHERE trim({_NAME}) <> ''),
a AS (SELECT doc_id, name, lang, source, '<' || name || ' [DESC] ' || lang || ' [TYPE] ' || source || '>' AS gold,
  CASE doc_id % 4 WHEN 0 THEN '<think>so </think> <' || name || ' [DESCRIPTION] ' || lang || ' [TYPE] ' || source || '></s>' WHEN 1 THEN '<''' || name || ''' [ desc ] ' || lang || ' [type] ' || source || '> tail' WHEN 2 THEN name ELSE '<' || name || '>' END AS raw FROM n)"""


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.trim(F.regexp_replace("text", "[^A-Za-z ]", ""))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), "lang", "source").where(F.col("name") != "")
    rest = lambda a, b: F.concat(F.lit(a), "lang", F.lit(b), "source")
    nth = F.col("doc_id") % 4
    raw = (
        F.when(nth == 0, F.concat(F.lit("<think>so </think> <"), "name", rest(" [DESCRIPTION] ", " [TYPE] "), F.lit("></s>")))
        .when(nth == 1, F.concat(F.lit("<'"), "name", F.lit("'"), rest(" [ desc ] ", " [type] "), F.lit("> tail"))).when(nth == 2, F.col("name")).otherwise(F.concat(F.lit("<"), "name", F.lit(">")))
    )
    return d.select("doc_id", "name", "lang", "source", F.concat(F.lit("<"), "name", rest(" [DESC] ", " [TYPE] "), F.lit(">")).alias("gold"), raw.alias("raw"))


@query(f"""WITH {_SHAPES}, c AS (SELECT *, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS k FROM a)
SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN '<' || k || ' [DESC] ' || lang || ' [TYPE] ' || source || '>' ELSE '<' || k || '>' END AS answer,
  CAST(doc_id % 4 < 2 AS INT) AS correct FROM c""")
def q21_normalised_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shapes(spark, sf_dir).withColumn("answer", reasoning.answer_form(F.col("raw")))
    return s.select("doc_id", "answer", (F.col("answer") == reasoning.answer_form(F.col("gold"))).cast("int").alias("correct"))


@query(f"""WITH {_SHAPES}, q AS (SELECT doc_id, name, 'The selected entity mention in the table cell is: ' || name || '. The column name for ''' || name || ''' is Name. The referent entity candidates are: ' || gold || ', <' || name || ' [DESC] x [TYPE] y> What is the correct referent entity for the entity mention ''' || name || '''?' AS q FROM a),
c AS (SELECT doc_id, name, regexp_extract_all(regexp_extract(q, '(?is)the referent entity candidates are:(.*?)(?:what is|$)', 1), '<[^>]+>') AS c FROM q)
SELECT doc_id, trim(regexp_replace(name, '\\s+', ' ', 'g')) AS mention, CAST(len(c) AS INT) AS n_candidates, c[1] AS first FROM c""")
def t25_question_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shapes(spark, sf_dir)
    candidates = F.array("gold", F.concat(F.lit("<"), "name", F.lit(" [DESC] x [TYPE] y>")))
    q = s.select("doc_id", text.question(F.col("name"), F.lit("Name"), candidates).alias("q"))
    found = text.question_candidates(F.col("q"))
    return q.select("doc_id", text.clean_text(text.question_mention(F.col("q"))).alias("mention"), F.size(found).alias("n_candidates"), F.get(found, F.lit(0)).alias("first"))
