"""Samples: context serialisation, questions, prompts, shard merges with gold backfill, pair data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.functions import scoring, text
from cellweave.operators import merging, pairs, quality, retrieval, sampling, tables
from cellweave.plans import candidates as C
from cellweave.plans import evaluation, merges
from cellweave.plans.reasoning import thoughts
from cellweave.plans.registry import query, table

_HEAD = "'[TLE] The Wikipedia page is about P' || c_nationkey || '. The Wikipedia section is about S. [TAB] col: | Name | Segment | '"
_ROWS = "SELECT c_nationkey, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer"


def segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A serialised table per nation, with its customers as rows."""
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("rows"))
    cells = F.transform("rows", lambda r: F.array(r["c_name"], r["c_mktsegment"]))
    page = F.concat(F.lit("P"), F.col("c_nationkey").cast("string"))
    return rows.select("c_nationkey", "rows", tables.input_seg(page, F.lit("S"), F.lit(""), F.array(F.lit("Name"), F.lit("Segment")), cells).alias("seg"))


@query(f"SELECT c_nationkey, md5({_HEAD} || string_agg('row ' || r || ': | ' || c_name || ' | ' || c_mktsegment || ' |', ' [SEP] ' ORDER BY r)) AS digest, count(*) AS n_rows FROM ({_ROWS}) GROUP BY c_nationkey")
def t6_input_seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segs(spark, sf_dir).select("c_nationkey", F.md5("seg").alias("digest"), F.size("rows").cast("long").alias("n_rows"))


@query(f"SELECT c_nationkey, r AS number, c_name || '|' || c_mktsegment AS cells FROM ({_ROWS})")
def t9_parsed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segs(spark, sf_dir).select("c_nationkey", F.explode(tables.seg_rows(F.col("seg"))).alias("r"))
    return rows.select("c_nationkey", F.col("r.number").cast("long").alias("number"), F.array_join("r.cells", "|").alias("cells"))


@query(f"""WITH k AS (SELECT *, least(n, 7) AS pos FROM ({_ROWS})), w AS (SELECT *, greatest(0, least(pos - 1 - 4, n - 10)) AS s FROM k)
SELECT c_nationkey, {_HEAD} || string_agg(CASE WHEN r = pos THEN 'row ' || r || ': | ' || c_name || ' | ' || c_mktsegment || ' |' ELSE 'row ' || r || ': ' || c_name END, ' [SEP] ' ORDER BY r) FILTER (n <= 10 OR (r > s AND r <= s + 10)) AS seg FROM w GROUP BY c_nationkey""")
def q7_simplified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seventh customer is the entity; its place is found from the question's mention and column."""
    s = segs(spark, sf_dir)
    mention = F.get("rows", F.least(F.size("rows"), F.lit(7)) - 1)["c_name"]
    s = s.select("c_nationkey", "seg", text.question(mention, F.lit("Name"), F.array(F.lit("<a>"))).alias("q"))
    s = s.withColumn("at", tables.find_entity(F.col("seg"), text.question_mention(F.col("q")), text.question_column(F.col("q"))))
    return s.select("c_nationkey", tables.simplify(F.col("seg"), F.col("at")).alias("seg"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM documents")
def t2_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("norm"))


@query(f"""WITH {C._RANKED}, k AS (SELECT mention_norm, list('<' || label || ' [DESCRIPTION] ' || description || ' [TYPE] ' || p31_label || '>' ORDER BY rank) AS c FROM t WHERE rank <= 5 GROUP BY 1)
SELECT mention_norm, 'The selected entity mention in the table cell is: ' || mention_norm || '. The column name for ''' || mention_norm || ''' is Part. The referent entity candidates are: ' || array_to_string(c, ', ') || ' What is the correct referent entity for the entity mention ''' || mention_norm || '''?' AS question, len(c) AS n_candidates FROM k""")
def t8_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.candidate_text(F.col("label"), F.col("qid"), F.col("description"), F.col("p31_label"))
    k = C.ranked(spark, sf_dir, 5).groupBy("mention_norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", name.alias("c")))), lambda s: s["c"]).alias("c"))
    q = k.withColumn("question", text.question(F.col("mention_norm"), F.lit("Part"), F.col("c")))
    # The strict parser must find what the builder put in.
    return q.select("mention_norm", "question", F.size(text.strict_candidates(F.col("question"), F.size("c"))).cast("long").alias("n_candidates"))


@query(f"""WITH {C._RANKED}, k AS (SELECT mention_norm, list(qid ORDER BY rank) AS c FROM t WHERE rank <= 5 GROUP BY 1), g AS (SELECT DISTINCT mention_norm, gold_qid FROM jobs),
m AS (SELECT g.*, list_contains(c, gold_qid) AS there, CASE WHEN list_contains(c, gold_qid) THEN c ELSE list_append(c, gold_qid) END AS c FROM g JOIN k USING (mention_norm)),
x AS (SELECT mention_norm, gold_qid, there, len(c) AS n, unnest(c) AS q, unnest(range(len(c))) AS i FROM m)
SELECT mention_norm, gold_qid, any_value(there) AS gold_was_there, any_value(n) AS n_candidates, string_agg(q, ',' ORDER BY md5('42|' || gold_qid || '|' || q || '|' || i)) AS candidates FROM x GROUP BY 1, 2""")
def q6_merged_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backfill a missing gold candidate, then shuffle with a seed."""
    k = C.ranked(spark, sf_dir, 5).groupBy("mention_norm").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "qid"))), lambda s: s["qid"]).alias("c"))
    g = C.jobs(spark, sf_dir).select("mention_norm", "gold_qid").distinct().join(k, "mention_norm")
    g = g.withColumn("there", F.array_contains("c", F.col("gold_qid"))).withColumn("c", merging.added_gold(F.col("c"), F.col("gold_qid")))
    return g.select("mention_norm", "gold_qid", F.col("there").alias("gold_was_there"), F.size("c").cast("long").alias("n_candidates"), F.array_join(sampling.shuffled(F.col("c"), 42, F.col("gold_qid")), ",").alias("candidates"))


@query("""WITH p AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5('### Instruction:' || chr(10) || 'Answer.' || chr(10) || chr(10) || '### Input:' || chr(10) || 'none' || chr(10) || chr(10) || '### Question:' || chr(10) || text || chr(10) || chr(10) || '### Response:' || chr(10)) AS digest, text AS question FROM p""")
def t40_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "conversations").where(F.col("role") == "user").withColumn("prompt", text.prompt(F.lit("Answer."), F.lit("none"), F.col("text")))
    return p.select("conv_id", "turn", F.md5("prompt").alias("digest"), text.prompt_question(F.col("prompt")).alias("question"))


@query(f"""WITH {merges._PAIRS}, a AS (SELECT conv_id, turn, '<' || accept AS chosen, 'x <' || reject AS rejected FROM p)
SELECT conv_id, turn, 'p<' AS prompt, substr(chosen, 2) AS accept, substr(rejected, 4) AS reject FROM a""")
def p18_aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = merges.conversation_pairs(spark, sf_dir).select("conv_id", "turn", F.lit("p").alias("prompt"), F.concat(F.lit("<"), "accept").alias("accept"), F.concat(F.lit("x <"), "reject").alias("reject"))
    return pairs.align(p).select("conv_id", "turn", "prompt", "accept", "reject")


@query(f"""WITH {evaluation._SHAPES}, k AS (SELECT lang || '|' || source AS key, gold, doc_id AS ord, raw FROM a WHERE doc_id % 4 < 2), f AS (SELECT gold, min(ord) AS ord FROM k GROUP BY 1)
SELECT a.doc_id, k.raw AS accept FROM a LEFT JOIN f ON f.gold = a.gold LEFT JOIN k ON k.ord = f.ord""")
def j11_reference_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pool output whose answer is a job's gold one. Names are cut to one blank run, as answers are."""
    s = evaluation.shapes(spark, sf_dir).withColumn("key", F.concat_ws("|", "lang", "source"))
    pool = s.where(F.col("doc_id") % 4 < 2).select("key", F.col("raw").alias("output"), F.col("doc_id").alias("ord"))
    return pairs.reference_output(s.select("doc_id", "key", "gold"), pool).select("doc_id", "accept")


@query("""WITH p AS (SELECT u.conv_id * 100 + u.turn AS ord, length(u.text) AS n_prompt, length(a.text) AS n_chosen, greatest(1, length(a.text) // 3) AS n_rejected FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
k AS (SELECT * FROM p WHERE n_prompt + greatest(n_chosen, n_rejected) <= 1500 AND n_chosen / greatest(1, n_rejected) <= 3.2)
SELECT ord, row_number() OVER (ORDER BY ord) - 1 AS row_id, row_number() OVER (ORDER BY md5('42|' || ord), ord) <= greatest(1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT)) AS is_eval FROM k""")
def q20_trainer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and ratio filters, dense ids, a seeded evaluation split."""
    p = merges.conversation_pairs(spark, sf_dir)
    n_chosen = F.length("accept")
    p = p.select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), F.length("prompt").alias("n_prompt"), n_chosen.alias("n_chosen"), F.greatest(F.lit(1), F.floor(n_chosen / 3).cast("int")).alias("n_rejected"))
    kept = pairs.funnel(p, pairs.length_filters(F.col("n_prompt"), F.col("n_chosen"), F.col("n_rejected"), 1500, 3.2)).where(F.col("drop_reason").isNull())
    return sampling.split(merging.dense_ids(kept.select("ord"), "ord"), "ord", 0.1).select("ord", "row_id", "is_eval")


@query("""WITH t AS (SELECT source, max(doc_id) AS l FROM documents GROUP BY 1 ORDER BY l DESC LIMIT 5)
SELECT source, arg_min(doc_id, md5('42|' || doc_id)) AS doc_id FROM documents WHERE source IN (SELECT source FROM t) GROUP BY 1""")
def r4_last_tables_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.one_per_group(sampling.last_tables(d, "source", 5, "doc_id"), ["source"], "doc_id")


@query("""WITH k AS (SELECT r_name AS label, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT label, n, label >= 'A' AND label < 'A' || chr(65535) AS in_range FROM k""")
def s14_graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statement counts per entity and a prefix range, as the graph queries ask for them."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return k.withColumn("in_range", (F.col("label") >= "A") & (F.col("label") < "A￿"))


@query("""SELECT part.p_partkey AS part, coalesce(b.p_type, 'owl#Thing') AS type_label FROM part LEFT JOIN (SELECT DISTINCT p_type FROM part WHERE p_type < 'M') b ON b.p_type = part.p_type""")
def j16_default_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    known = p.select("p_type").where(F.col("p_type") < "M").distinct().withColumn("label", F.col("p_type"))
    return p.join(known, "p_type", "left").select(F.col("p_partkey").alias("part"), F.coalesce("label", F.lit("owl#Thing")).alias("type_label"))


@query("SELECT c_custkey, c_name, lower(c_name) AS low, CASE WHEN c_name = lower(c_name) THEN 2 ELSE 3 END - CASE WHEN c_name = upper(c_name[1]) || lower(c_name[2:]) THEN 1 ELSE 0 END AS n FROM customer")
def t46_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = text.name_variants(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.element_at(v, -1).alias("low"), F.size(v).alias("n"))


@query("""WITH t AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), w AS (SELECT doc_id, list_distinct(w[:len(w) // 2]) AS a, list_distinct(w[len(w) // 2 + 1:]) AS b FROM t)
SELECT doc_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS overlap FROM w""")
def m4_context_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each text's words against the second."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda t: t != "").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    d = d.select("doc_id", F.array_distinct(F.slice("w", 1, half)).alias("a"), F.array_distinct(F.slice("w", half + 1, F.greatest(F.size("w"), F.lit(1)))).alias("b"))
    return d.select("doc_id", F.round(scoring.jaccard(F.col("a"), F.col("b")), 6).alias("overlap"))


@query("SELECT count(*) FILTER (trim(text) <> '') AS n_lines, count(*) AS n_rows, count(DISTINCT source) AS n_tables FROM documents")
def a16_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count_if(~text.is_blank(F.col("text"))).alias("n_lines"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct("source").alias("n_tables"))


@query("""WITH e AS (SELECT event_id, coalesce(TRY_CAST(event_type AS DOUBLE), 0.0) AS bad, coalesce(TRY_CAST(props->>'$.k' AS DOUBLE), 0.0) AS good, value / greatest(1, user_id) AS ratio FROM events) SELECT event_id, bad, good, round(ratio, 9) AS ratio FROM e""")
def m7_safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", scoring.safe_double(F.col("event_type")).alias("bad"), scoring.safe_double(F.get_json_object("props", "$.k")).alias("good"), F.round(scoring.length_ratio(F.col("value"), F.col("user_id")), 9).alias("ratio"))


@query()
def a8_compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and averages of the compression, which SQL can't say."""
    return quality.compression_report(quality.compress(thoughts(spark, sf_dir), "output", target_tokens=40))


@query()
def t36_shortened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasoning of whole texts cut to three sentences and 120 characters."""
    return thoughts(spark, sf_dir).select("doc_id", R.shortened(F.coalesce(R.think_of(F.col("output")), F.lit("")), 3, 120).alias("short"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42|' || doc_id), doc_id) AS r, min(doc_id) OVER (PARTITION BY source, lang) AS f FROM documents) SELECT source, lang, doc_id, f AS first_seen FROM r WHERE r = 1""")
def q9_one_per_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    first = d.groupBy("source", "lang").agg(F.min("doc_id").alias("first_seen"))
    return sampling.one_per_group(d, ["source", "lang"], "doc_id").join(first, ["source", "lang"]).select("source", "lang", "doc_id", "first_seen")


@query("""WITH s AS (SELECT p_partkey, p_size, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, length(p_name), p_partkey) AS rank FROM part) SELECT p_type, p_partkey, rank FROM s WHERE rank <= 3""")
def o2_many_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return retrieval.top(p, ["p_type"], [F.col("p_size").desc(), F.length("p_name"), F.col("p_partkey")], 3).select("p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))
