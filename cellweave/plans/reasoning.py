"""Quality filter and compression over reasoning texts made from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.operators import quality
from cellweave.plans.registry import query, table

_PHRASES = [
    "The column header and the row say so, because the description matches the context.",
    "Now output after reasoning.",
    "Hmm, but wait, let me reconsider. Unlike the other candidate, this type fits.",
    "The final answer is <X [DESC] a [TYPE] b>. The verified answer is given.",
    "",
]


def thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning texts made from whole documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z .]", "").alias("t"))
    nth = (F.col("doc_id") % len(_PHRASES)).cast("int")
    body = F.concat(F.get(F.array(*map(F.lit, _PHRASES)), nth), F.lit(" "), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("t")))
    return d.select("doc_id", F.when(F.col("doc_id") % 7 == 6, body).otherwise(F.concat(F.lit("<think>\n"), body, F.lit("\n</think>\n<Y [DESC] a [TYPE] b>"))).alias("output"))


def _sql_hits(patterns: list[str], of: str) -> str:
    return "(" + " + ".join("CAST(regexp_matches({}, '(?i){}') AS INT)".format(of, p.replace("'", "''")) for p in patterns) + ")"


_CASES = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES))
_THOUGHTS = f"""b AS (SELECT doc_id, (CASE doc_id % {len(_PHRASES)} {_CASES} END) || ' ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE regexp_replace(text, '[^A-Za-z .]', '', 'g') END AS body FROM documents),
h AS (SELECT doc_id, doc_id % 7 <> 6 AS has, CASE WHEN doc_id % 7 = 6 THEN '' ELSE trim(body) END AS think, body FROM b),
f AS (SELECT doc_id, has, think, length(think) AS chars, {_sql_hits(R.TEMPLATE, "think")} AS template, {_sql_hits(R.EVIDENCE, "think")} AS evidence, {_sql_hits(R.JUSTIFY, "think")} AS justify, {_sql_hits(R.CONTRAST, "think")} AS contrast,
  {_sql_hits(R.LEAKAGE, "think")} AS leakage, {_sql_hits(R.RAMBLE, "think")} AS ramble, {_sql_hits(R.REFUSAL, "body")} AS refusal, has AND contains(think, '<X [DESC]') AS other FROM h),
s AS (SELECT *, CASE WHEN evidence = 0 THEN 3 ELSE 0 END + CASE WHEN justify = 0 AND contrast = 0 THEN 3 ELSE 0 END + CASE WHEN chars < 80 THEN 2 ELSE 0 END + CASE WHEN template > 0 THEN least(4, 1 + template) ELSE 0 END
  + CASE WHEN leakage > 0 THEN least(2, leakage) ELSE 0 END + CASE WHEN ramble >= 2 THEN 2 + CAST(ramble >= 4 AS INT) ELSE 0 END + CASE WHEN other THEN 4 ELSE 0 END
  - CASE WHEN evidence > 0 AND (justify > 0 OR contrast > 0) THEN 2 ELSE 0 END - CASE WHEN contrast > 0 THEN least(3, 1 + contrast) ELSE 0 END - CASE WHEN evidence >= 3 THEN 1 ELSE 0 END AS score FROM f),
t AS (SELECT *, CASE WHEN NOT has OR chars = 0 OR refusal > 0 OR (chars < 40 AND evidence = 0) OR (template > 0 AND evidence = 0 AND contrast = 0) THEN 'hard_drop' WHEN score >= 3 THEN 'low_info' ELSE 'keep' END AS tag FROM s)"""


@query(f"WITH {_THOUGHTS} SELECT doc_id, score, tag FROM t")
def q11_low_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.low_info(thoughts(spark, sf_dir), "output").select("doc_id", "score", "tag")


@query(f"""WITH {_THOUGHTS}, r AS (SELECT unnest([CASE WHEN evidence = 0 THEN 'no_evidence_terms' END, CASE WHEN justify = 0 AND contrast = 0 THEN 'no_justification' END, CASE WHEN chars < 80 THEN 'short_think<80' END,
  CASE WHEN template > 0 THEN 'template_phrases' END, CASE WHEN leakage > 0 THEN 'answer_leakage' END, CASE WHEN ramble >= 2 THEN 'rambling' END, CASE WHEN other THEN 'answer_inconsistent' END,
  CASE WHEN evidence > 0 AND (justify > 0 OR contrast > 0) THEN 'grounded_and_justified' END, CASE WHEN contrast > 0 THEN 'has_contrast' END, CASE WHEN evidence >= 3 THEN 'rich_evidence' END]) AS reason FROM t)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, reason LIMIT 20""")
def a7_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_counts(quality.low_info(thoughts(spark, sf_dir), "output"))


@query(f"WITH {_THOUGHTS} SELECT doc_id, trim(think) AS think, '<Y [DESC] a [TYPE] b>' AS entity FROM t WHERE has")
def t13_parsed_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = thoughts(spark, sf_dir).select("doc_id", R.parse_output(F.col("output")).alias("p")).where(F.col("p").isNotNull())
    return p.select("doc_id", "p.think", "p.entity")


@query()
def q12_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy over sentences, which SQL can't say; the tests hold it against a plain version."""
    return quality.compress(thoughts(spark, sf_dir), "output", target_tokens=40).select("doc_id", "compressed", "reason", "before_tokens", "after_tokens")
