"""Small operators on their own, each over a whole table: field fallbacks, filters, forms of answers, best rows, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.functions import text
from cellweave.operators import knowledge, merging, metrics, pairs, retrieval
from cellweave.plans.answers import _NAMES, cases, named
from cellweave.plans.candidates import _NORM
from cellweave.plans.merges import conversation_pairs
from cellweave.plans.registry import query, table


@query(f"""WITH {_NAMES} SELECT idx, CASE idx % 4 WHEN 0 THEN '<think> ' || name || ' </think>' || gold WHEN 1 THEN '' WHEN 2 THEN seg ELSE '<think>  </think>' END AS first_text, idx % 4 = 0 AS has_reasoning FROM k""")
def p13_with_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several fields that is a string, an empty one included, and whether it holds reasoning."""
    n = named(spark, sf_dir)
    whole = F.concat(F.lit("<think> "), "name", F.lit(" </think>"), "gold")
    output = F.when(F.col("idx") % 4 == 0, whole).when(F.col("idx") % 4 == 1, "")
    answer = F.when(F.col("idx") % 4 == 2, F.col("seg")).when(F.col("idx") % 4 == 3, "<think>  </think>").otherwise("<think>late</think>")
    fields = (output, F.lit(None).cast("string"), answer)
    return n.select("idx", pairs.first_text(*fields).alias("first_text"), pairs.has_reasoning(*fields).alias("has_reasoning"))


@query("""WITH p AS (SELECT length(u.text) AS a, length(a.text) AS b FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')
SELECT CASE WHEN a >= 150 THEN 'all_masked' WHEN a + b > 150 THEN 'too_long' WHEN b > 120 THEN 'output_too_long' ELSE 'kept' END AS step, count(*) AS n FROM p GROUP BY 1""")
def p19_training_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pairs(spark, sf_dir)
    kept = pairs.funnel(p, pairs.training_lengths(F.length("prompt"), F.length("accept"), 150, 120))
    return kept.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NAMES} SELECT idx AS ord, idx % 3 = 0 AS wrong, idx % 4 <> 1 AS unclosed FROM k WHERE idx % 3 = 0 OR idx % 4 <> 1")
def p21_wrong_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(spark, sf_dir).select(F.col("idx").alias("ord"), (F.col("idx") % 3 > 0).cast("int").alias("correct"), cases(F.col("idx"), 4, {1: "<think>a</think>b", 2: "<think>open"}, F.lit(None).cast("string")).alias("raw_prediction"))
    return pairs.wrong_lines(n)


@query(f"""WITH {_NAMES} SELECT idx, gold[2:-2] AS marker_form, name AS without_end, idx % 3 = 0 AS has_think, CASE WHEN idx % 3 = 0 THEN 'a' END AS think, 'say ' || chr(92) || chr(34) || name || chr(92) || chr(34) || ' ' || chr(92) || chr(92) AS literal FROM k""")
def t18_answer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One spelling of markers, no end mark, think blocks, escaped literals."""
    n = named(spark, sf_dir)
    spelled = F.regexp_replace(F.regexp_replace("gold", r"\[DESC\]", "[ description ]"), r"\[TYPE\]", "[Type]")
    answer = F.when(F.col("idx") % 3 == 0, "<think> a </think>").when(F.col("idx") % 3 == 1, "<THINK").otherwise("</think> a")
    return n.select(
        "idx", R.marker_form(F.concat(F.lit(" <"), spelled, F.lit(">>"))).alias("marker_form"), R.without_end(F.concat(F.lit(" "), "name", F.lit("</S> "))).alias("without_end"),
        R.has_think(answer).alias("has_think"), R.think_of(answer).alias("think"), text.query_literal(F.concat(F.lit('say "'), "name", F.lit('" \\'))).alias("literal"),
    )


@query(f"""WITH v AS (SELECT 'Q' || (event_id % 50) AS qid, event_id AS ord, event_type AS label, 'name ' || (event_id % 70) AS alias FROM events), l AS (SELECT qid, arg_max(label, ord) AS label FROM v GROUP BY 1),
a AS (SELECT DISTINCT qid, {_NORM.format("label")} AS alias_norm, 'label' AS source FROM v UNION SELECT DISTINCT qid, {_NORM.format("alias")}, 'alias' FROM v), n AS (SELECT qid, count(*) AS n_aliases FROM a GROUP BY 1) SELECT qid, label, n_aliases FROM l JOIN n USING (qid)""")
def k6_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each entity; aliases of all versions stay in the index."""
    v = table(spark, sf_dir, "events").select(F.concat(F.lit("Q"), F.col("event_id") % 50).alias("qid"), F.col("event_id").alias("ord"), F.col("event_type").alias("label"), F.lit("").alias("enwiki_title"), F.array(F.concat(F.lit("name "), F.col("event_id") % 70)).alias("aliases"))
    n = knowledge.alias_index(v, ascii_only=True).groupBy("qid").agg(F.count(F.lit(1)).alias("n_aliases"))
    return knowledge.upsert(v).select("qid", "label").join(n, "qid")


@query("WITH r AS (SELECT user_id, event_id, floor(value) AS value, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS r FROM events) SELECT user_id, event_id FROM r WHERE r = 1")
def a4_best_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each key; of equal ones the first."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor("value").alias("v"))
    return retrieval.top(e, ["user_id"], [F.col("v").desc(), F.col("event_id")], 1).select("user_id", "event_id")


@query(f"WITH {_NAMES} SELECT idx FROM k WHERE idx % 3 = 2")
def p20_outside_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions that are none of the candidates, whatever the spelling of their markers."""
    n = named(spark, sf_dir).withColumn("c", F.array("gold", "wrong"))
    said = F.when(F.col("idx") % 3 == 0, F.replace("gold", F.lit("[DESC]"), F.lit("[DESCRIPTION]"))).when(F.col("idx") % 3 == 1, F.concat("wrong", F.lit("</s>"))).otherwise(F.col("longer"))
    return metrics.outside_candidates(n.withColumn("p", said), "p", "c").select("idx")


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 50")
def o4_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.take_exactly(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), 50, "doc_id")


@query("""WITH r AS (SELECT c_nationkey, c_custkey, trim(regexp_replace(c_name, '\\s+', ' ', 'g')) AS a, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS b FROM customer) SELECT c_custkey, CASE WHEN b = '' THEN a ELSE a || ' | ' || b END AS context FROM r""")
def t7_row_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    cells = F.array(F.concat(F.lit(" "), "c_name"), F.when(F.col("c_custkey") % 2 == 0, F.lit("  ")).otherwise(F.col("c_mktsegment")), F.lit(None).cast("string"))
    return c.select("c_custkey", text.row_context(cells).alias("context"))
