"""Merging, resuming and step logs over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators import merging, metrics, pairs
from cellweave.plans.registry import query, table


def _main_and_shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("idx"), F.col("event_id").alias("ord"), "event_type", "value")
    return e.where(F.col("event_type") == "click"), e.where(F.col("event_type") != "click")


@query("""WITH m AS (SELECT user_id AS idx, max(event_id) AS ord FROM events WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT user_id AS idx, min(event_id) AS ord FROM events WHERE event_type <> 'click' AND user_id NOT IN (SELECT idx FROM m) GROUP BY 1)
SELECT idx, event_id AS ord, event_type, value FROM (SELECT * FROM m UNION ALL SELECT * FROM s) k JOIN events ON event_id = ord""")
def j12_merge_main_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_main_wins(*_main_and_shards(spark, sf_dir)).select("idx", "ord", "event_type", "value")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'click') DESC, event_id DESC) AS r FROM events)
SELECT user_id AS idx, event_id AS ord, event_type, value FROM r WHERE r = 1""")
def j13_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_last_wins(list(_main_and_shards(spark, sf_dir))).select("idx", "ord", "event_type", "value")


@query("""WITH m AS (SELECT user_id AS idx, max(event_id) AS ord FROM events WHERE event_type = 'click' GROUP BY 1), d AS (SELECT user_id AS idx, max(event_id) AS ord FROM events WHERE event_type <> 'click' GROUP BY 1),
c AS (SELECT coalesce(d.idx, m.idx) AS idx, coalesce(d.ord, m.ord) AS ord, d.ord IS NOT NULL AS changed FROM m FULL JOIN d ON m.idx = d.idx)
SELECT idx, ord, value FROM c JOIN events ON event_id = ord WHERE NOT (changed AND event_type = 'error')""")
def j14_apply_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    main, shards = _main_and_shards(spark, sf_dir)
    delta = shards.withColumn("dropped", F.col("event_type") == "error")
    return merging.apply_delta(main, delta).select("idx", "ord", "value")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def j15_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return merging.pending(e, e.where(F.col("event_type") == "error"), "user_id").select("event_id", "user_id")


@query("SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS row_id FROM events WHERE event_type <> 'error'")
def w6_dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type") != "error").select("event_id", "user_id")
    return merging.dense_ids(e, "event_id").select("event_id", "user_id", "row_id")


@query("""WITH a AS (SELECT user_id, event_id AS step, value AS score, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT user_id, step, greatest(score, coalesce(b, score)) AS best, b IS NULL OR score > b AS is_best FROM a""")
def w7_running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step"), F.col("value").alias("score"))
    return metrics.running_best(e, "user_id").select("user_id", "step", "best", "is_best")


@query("SELECT event_id AS step, value + 0.5 AS score FROM events ORDER BY score DESC, step LIMIT 10")
def q24_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), metrics.checkpoint_score(F.col("value"), F.lit(0.5)).alias("score"))
    return metrics.leaderboard(e, 10)


@query("SELECT event_id, event_type, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def p9_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k long")["k"].alias("k"))


_PAIRS = """p AS (SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS accept, CASE WHEN u.turn % 3 = 0 THEN '' WHEN u.turn % 3 = 1 THEN left(a.text, length(a.text) // 2) || '</s> more' ELSE left(a.text, length(a.text) // 3) END AS reject
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("accept"))
    nth = F.col("turn") % 3
    cut = F.when(nth == 0, "").when(nth == 1, F.concat(F.left("accept", F.floor(F.length("accept") / 2).cast("int")), F.lit("</s> more"))).otherwise(F.left("accept", F.floor(F.length("accept") / 3).cast("int")))
    return u.join(a, ["conv_id", "turn"]).withColumn("reject", cut)


@query(f"""WITH {_PAIRS}, r AS (SELECT CASE WHEN trim(accept) = '' OR trim(reject) = '' THEN 'missing_field' WHEN reject LIKE '%</s> more' THEN 'collapsed' WHEN length(accept) / greatest(1, length(reject)) > 3.005 THEN 'ratio' END AS drop_reason FROM p)
SELECT coalesce(drop_reason, 'kept') AS step, count(*) AS n FROM r GROUP BY 1""")
def q16_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conversation_pairs(spark, sf_dir)
    first = pairs.collapse_reason(F.col("accept"), F.col("reject"))
    steps = [("missing_field", first == "missing_field"), ("collapsed", first == "collapsed"), *pairs.length_filters(F.length("prompt"), F.length("accept"), F.length("reject"), 10_000_000, 3.005)]
    return pairs.funnel(p, steps).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations WHERE role = 'assistant')
SELECT conv_id, nth, u.text AS question, a.text AS output FROM u JOIN a USING (conv_id, nth)""")
def j9_zip_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nth question of a conversation beside its nth answer, where both sides have as many."""
    nth = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    c = table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")).withColumn("nth", nth.cast("long"))
    n = c.groupBy("conv_id").agg(F.max(F.when(F.col("role") == "user", F.col("nth"))).alias("u"), F.max(F.when(F.col("role") == "assistant", F.col("nth"))).alias("a"))
    c = c.join(n.na.fill(0), "conv_id").where(F.col("nth") <= F.least("u", "a"))
    side = lambda role, name: c.where(F.col("role") == role).select("conv_id", "nth", F.col("text").alias(name))
    return merging.zip_rows(side("user", "question"), side("assistant", "output"), ["conv_id", "nth"])


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type")
