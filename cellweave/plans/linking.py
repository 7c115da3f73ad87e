"""Linking in full over the star schema: three ways of retrieval, all features, audit rows, previews, remote rankers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import scoring, text
from cellweave.operators import linking, merging, mining, retrieval, sampling, tables
from cellweave.plans.candidates import _NORM, supplier_tables
from cellweave.plans.registry import query, table
from cellweave.sources import remote

_TYPE = "CASE p_size % 4 WHEN 0 THEN 'human' WHEN 1 THEN 'city' WHEN 2 THEN 'film studio' ELSE lower(p_type) END"
_KB = f"""kb AS (SELECT 'Q' || p_partkey AS qid, p_partkey AS ord, p_name AS label, p_brand || ' size ' || p_size AS description, {_TYPE} AS p31_label, {_NORM.format("p_name")} AS norm,
  {_NORM.format("p_brand || ' size ' || p_size")} AS description_norm, {_NORM.format(_TYPE)} AS type_norm, {_NORM.format(f"p_name || ' ' || p_brand || ' ' || {_TYPE}")} AS body FROM part)"""
_JOBS = f"""jobs AS (SELECT l_orderkey, l_linenumber, {_NORM.format("CASE l_linenumber % 4 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 2) WHEN 2 THEN p_name || ' ' || p_brand ELSE left(p_name, length(p_name) - 2) END")} AS mention_norm,
  CASE l_returnflag WHEN 'A' THEN 'name' WHEN 'N' THEN 'city name' ELSE 'part' END AS column_norm, CASE l_linestatus WHEN 'O' THEN 'size 10 brand 11' ELSE 'page of parts' END AS context_norm, 'Q' || p_partkey AS gold_qid
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    norm = lambda *c: text.normalize_text(F.concat_ws(" ", *c), ascii_only=True)
    kind = F.when(F.col("p_size") % 4 == 0, "human").when(F.col("p_size") % 4 == 1, "city").when(F.col("p_size") % 4 == 2, "film studio").otherwise(F.lower("p_type"))
    description = F.concat("p_brand", F.lit(" size "), "p_size")
    return p.select(
        F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), description.alias("description"), kind.alias("p31_label"),
        norm("p_name").alias("norm"), norm(description).alias("description_norm"), norm(kind).alias("type_norm"), norm("p_name", "p_brand", kind).alias("body"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The four mentions of a part are normalised once, not for each of its rows.
    name, brand = F.col("p_name"), F.col("p_brand")
    ways = [name, F.split_part(name, F.lit(" "), F.lit(2)), F.concat_ws(" ", name, brand), F.left(name, F.length(name) - 2)]
    p = table(spark, sf_dir, "part").select("p_partkey", F.array(*(text.normalize_text(w, ascii_only=True) for w in ways)).alias("ways"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        "l_orderkey", "l_linenumber", F.get("ways", F.col("l_linenumber") % 4).alias("mention_norm"), F.when(F.col("l_returnflag") == "A", "name").when(F.col("l_returnflag") == "N", "city name").otherwise("part").alias("column_norm"),
        F.when(F.col("l_linestatus") == "O", "size 10 brand 11").otherwise("page of parts").alias("context_norm"), F.concat(F.lit("Q"), "p_partkey").alias("gold_qid"),
    )


_ITEMS = "list_filter(string_split({}, ' '), lambda x: x <> '')"


def _linked_sql(with_prefix: bool) -> str:
    """CTEs from kb and jobs to ranked: the same formulas, written over lists and windows."""
    pf = "UNION ALL SELECT mention_norm, qid, 1000000 + row_number() OVER (PARTITION BY mention_norm ORDER BY ord, qid) AS place, 80 AS most FROM m JOIN kb ON starts_with(norm, mention_norm)" if with_prefix else ""
    return f"""
asked AS (SELECT DISTINCT mention_norm, column_norm, context_norm FROM jobs WHERE mention_norm <> ''), m AS (SELECT DISTINCT mention_norm FROM asked),
c AS (SELECT mention_norm, gold_qid AS qid, count(*) AS n FROM jobs WHERE mention_norm <> '' GROUP BY 1, 2), prior AS (SELECT mention_norm, qid, n / max(n) OVER (PARTITION BY mention_norm) AS prior FROM c),
i AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_ITEMS.format("body")}) AS term FROM kb) GROUP BY 1, 2), ln_ AS (SELECT qid, len({_ITEMS.format("body")}) AS size FROM kb),
st AS (SELECT count(*) AS n, avg(size) AS average FROM ln_), df AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
q AS (SELECT mention_norm, term, count(*) AS times FROM (SELECT mention_norm, unnest({_ITEMS.format("mention_norm")}[1:8]) AS term FROM m) GROUP BY 1, 2),
b AS (SELECT mention_norm, qid, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))), 9) AS bm25 FROM q JOIN df USING (term) JOIN i USING (term) JOIN ln_ USING (qid), st GROUP BY 1, 2),
br AS (SELECT *, row_number() OVER (PARTITION BY mention_norm ORDER BY bm25 DESC, qid) AS r FROM b), ft AS (SELECT *, min(bm25) OVER (PARTITION BY mention_norm) AS lo, max(bm25) OVER (PARTITION BY mention_norm) AS hi FROM br WHERE r <= 120),
src AS (SELECT mention_norm, qid, row_number() OVER (PARTITION BY mention_norm ORDER BY ord, qid) AS place, 80 AS most FROM m JOIN kb ON norm = mention_norm {pf} UNION ALL SELECT mention_norm, qid, 2000000 + r, 120 FROM ft),
pl AS (SELECT mention_norm, qid, min(place) AS place FROM src WHERE place % 1000000 <= most GROUP BY 1, 2), pr AS (SELECT *, row_number() OVER (PARTITION BY mention_norm ORDER BY place) AS nth FROM pl),
nm AS (SELECT DISTINCT mention_norm, norm FROM pr JOIN kb USING (qid) WHERE nth <= 260),
sm AS (SELECT mention_norm, norm, {_ITEMS.format("mention_norm")} AS a, {_ITEMS.format("norm")} AS w, len(list_filter(range(1, least(length(mention_norm), length(norm)) + 1), lambda k: left(mention_norm, k) = left(norm, k))) AS pre FROM nm),
si AS (SELECT mention_norm, norm, CASE WHEN mention_norm = norm THEN 1.0 ELSE 0.75 * len(list_intersect(a, w)) / greatest(1, len(list_distinct(list_concat(a, w)))) + 0.25 * pre / greatest(1, length(mention_norm), length(norm)) END AS sim FROM sm),
e AS (SELECT pr.mention_norm, pr.qid, nth, kb.norm, description_norm, type_norm, sim, coalesce(prior, 0) AS prior, CASE WHEN bm25 IS NULL OR hi - lo <= 1e-12 THEN 0 ELSE (bm25 - lo) / (hi - lo) END AS bm
  FROM pr JOIN kb USING (qid) JOIN si ON si.mention_norm = pr.mention_norm AND si.norm = kb.norm LEFT JOIN prior ON prior.mention_norm = pr.mention_norm AND prior.qid = pr.qid LEFT JOIN ft ON ft.mention_norm = pr.mention_norm AND ft.qid = pr.qid WHERE nth <= 260),
cx AS (SELECT *, len(list_intersect({_ITEMS.format("description_norm")}, {_ITEMS.format("context_norm")})) / greatest(1, len(list_distinct(list_concat({_ITEMS.format("description_norm")}, {_ITEMS.format("context_norm")})))) AS ctx FROM (SELECT DISTINCT description_norm FROM kb), (SELECT DISTINCT context_norm FROM asked)),
s AS (SELECT a.*, qid, nth, round(3.8 * CAST(norm = a.mention_norm AS INT) + 1.3 * CAST(contains(norm, a.mention_norm) AS INT) + 2.3 * sim + 1.8 * prior + 0.9 * ctx + 1.4 * bm
  + CASE WHEN list_contains(string_split(column_norm, ' '), 'name') AND contains(type_norm, 'human') OR list_contains(string_split(column_norm, ' '), 'city') AND contains(type_norm, 'city') THEN 1.0 ELSE 0 END, 6) AS score
  FROM asked a JOIN e ON e.mention_norm = a.mention_norm JOIN cx ON cx.description_norm = e.description_norm AND cx.context_norm = a.context_norm),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mention_norm, column_norm, context_norm ORDER BY score DESC, nth) AS rank FROM s)"""


_LINKED = _linked_sql(True)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    return linking.link(j, kb(spark, sf_dir), retrieval.prior(j))


@query(f"WITH {_KB}, {_JOBS}, {_LINKED} SELECT mention_norm, column_norm, context_norm, qid, nth AS place, CAST(floor(score * 100 + 0.0037) AS BIGINT) AS hundredths, rank FROM ranked WHERE rank <= 20")
def q4_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, prefix and full-text retrieval, all seven features, the best 20 per mention in its column and context. The
    score is given in hundredths, which don't depend on the order of sums."""
    return linked(spark, sf_dir).select("mention_norm", "column_norm", "context_norm", "qid", F.col("place").cast("long").alias("place"), F.floor(F.col("score") * 100 + 0.0037).alias("hundredths"), "rank")


@query(f"""WITH {_KB}, {_JOBS}, {_LINKED}, l AS (SELECT mention_norm, column_norm, context_norm, list(qid ORDER BY rank) AS c FROM ranked WHERE rank <= 20 GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, gold_qid, array_to_string(coalesce(c, []), ',') AS candidate_qids, coalesce(list_contains(c, gold_qid), false) AS gold_in_topk, coalesce(len(c), 0) AS candidate_count FROM jobs LEFT JOIN l USING (mention_norm, column_norm, context_norm)""")
def q4_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit row of every job."""
    rows = linking.audit(jobs(spark, sf_dir), linked(spark, sf_dir))
    return rows.select("l_orderkey", "l_linenumber", "gold_qid", F.array_join("candidate_qids", ",").alias("candidate_qids"), "gold_in_topk", "candidate_count")


_PREVIEW = f"""jobs AS (SELECT 's1.json#' || row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) || ':0' AS job_id, p_name AS mention, {_NORM.format("p_name")} AS mention_norm, 'part' AS column_norm, '' AS context_norm, 'Q' || p_partkey AS gold_qid
  FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_suppkey = 1)"""


@query(f"""WITH {_KB}, {_PREVIEW}, {_linked_sql(False)}, l AS (SELECT mention_norm, list(qid ORDER BY rank) AS c FROM ranked WHERE rank <= 20 GROUP BY 1)
SELECT job_id, mention, array_to_string(c, ',') AS candidate_qids, len(c) AS candidate_count, '<' || label || ' [DESCRIPTION] ' || description || ' [TYPE] ' || p31_label || '>' AS output, count(*) OVER () AS sample_count FROM jobs JOIN l USING (mention_norm) JOIN kb ON kb.qid = gold_qid""")
def q5_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table's samples: the prior comes from that table alone, there is no context, prefixes aren't asked for."""
    t = supplier_tables(spark, sf_dir).where(F.col("source_file") == "s1.json")
    j = tables.mention_jobs(t).withColumn("mention_norm", text.normalize_text(F.col("mention"), ascii_only=True)).withColumn("column_norm", F.lit("part")).withColumn("context_norm", F.lit(""))
    known = kb(spark, sf_dir)
    rows = linking.gold_output(linking.audit(j, linking.link(j, known, retrieval.prior(j), use_prefix=False)), known)
    n = rows.agg(F.count(F.lit(1)).alias("sample_count"))
    return rows.join(F.broadcast(n)).select("job_id", "mention", F.array_join("candidate_qids", ",").alias("candidate_qids"), "candidate_count", "output", "sample_count")


@query(f"""WITH {_KB}, j AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN ' Q' || s_suppkey WHEN 1 THEN 'Q0' ELSE '' END AS gold_qid, CASE WHEN s_suppkey % 2 = 0 THEN replace(s_name, '#', '_') ELSE '' END AS title, s_name AS mention FROM supplier)
SELECT s_suppkey, CASE WHEN label IS NOT NULL THEN '<' || label || ' [DESCRIPTION] ' || description || ' [TYPE] ' || p31_label || '>' ELSE '<' || CASE WHEN title <> '' THEN replace(title, '_', ' ') ELSE mention END || ' [DESCRIPTION] None [TYPE] None>' END AS output
FROM j LEFT JOIN kb ON kb.qid = trim(gold_qid)""")
def j8_gold_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, third = table(spark, sf_dir, "supplier"), F.col("s_suppkey") % 3
    j = s.select("s_suppkey", F.when(third == 0, F.concat(F.lit(" Q"), "s_suppkey")).when(third == 1, "Q0").otherwise("").alias("gold_qid"), F.when(F.col("s_suppkey") % 2 == 0, F.replace("s_name", F.lit("#"), F.lit("_"))).otherwise("").alias("gold_wiki_title"), F.col("s_name").alias("mention"))
    return linking.gold_output(j, kb(spark, sf_dir)).select("s_suppkey", "output")


@query("""WITH r AS (SELECT c_nationkey AS request, 'Q' || (c_custkey % 3000) AS qid, min(c_custkey) AS ord FROM customer GROUP BY 1, 2)
SELECT request, qid, p_name AS label, row_number() OVER (PARTITION BY request ORDER BY ord) AS place FROM r JOIN part ON 'Q' || p_partkey = qid""")
def j5_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of ids looked up in the order asked for, each once."""
    r = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("request"), F.concat(F.lit("Q"), F.col("c_custkey") % 3000).alias("qid"), F.col("c_custkey").alias("ord"))
    return linking.lookup(r, kb(spark, sf_dir).select("qid", "label")).select("request", "qid", "label", "place")


@query("SELECT l_orderkey, l_linenumber, s_name AS caption FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def j10_jobs_with_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda c: F.concat(F.lit("tables/"), c, F.lit(".json")).alias("source_path")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", path(F.col("l_suppkey")))
    return linking.with_table(j, table(spark, sf_dir, "supplier").select(path(F.col("s_suppkey")), F.col("s_name").alias("caption"))).select("l_orderkey", "l_linenumber", "caption")


_GRAPH = "g AS (SELECT 'Q' || p_partkey AS entity_id, p_partkey AS ord, p_name AS label, CAST(p_size AS DOUBLE) AS score, p_partkey % 50 AS sitelinks, contains(lower(p_type), 'economy') AS dis FROM part), n AS (SELECT 'Q' || l_partkey AS entity_id, count(*) AS stmts FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1)"
_WORDS = "list_filter(string_split({}, ' '), lambda x: x <> '')"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    uri = lambda c: F.concat(F.lit("http://x/entity/Q"), c)
    g = table(spark, sf_dir, "part").select(
        uri(F.col("p_partkey")).alias("uri"), text.qid_of_uri(uri(F.col("p_partkey"))).alias("entity_id"), F.col("p_name").alias("label"), F.col("p_size").cast("double").alias("score"), (F.col("p_partkey") % 50).alias("sitelinks"),
        scoring.is_disambiguation(F.lit(None).cast("string"), F.replace(F.lower("p_type"), F.lit("economy"), F.lit("disambiguation"))).alias("is_disambiguation"), F.col("p_partkey").alias("ord"),
    )
    statements = table(spark, sf_dir, "lineitem").where(F.col("l_partkey") % 3 > 0).select(uri(F.col("l_partkey")).alias("subject"))
    return g, linking.statement_counts(statements, "subject")


@query(f"""WITH {_GRAPH}, m AS (SELECT DISTINCT p_name AS mention FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part UNION SELECT DISTINCT upper(p_name) FROM part),
v0 AS (SELECT mention, mention AS variant, 0 AS turn FROM m UNION ALL SELECT mention, array_to_string(list_transform(string_split(lower(mention), ' '), lambda w: upper(w[1]) || w[2:]), ' '), 1 FROM m UNION ALL SELECT mention, lower(mention), 2 FROM m),
v AS (SELECT mention, variant, row_number() OVER (PARTITION BY mention ORDER BY min(turn)) - 1 AS turn FROM v0 GROUP BY 1, 2),
x AS (SELECT mention, g.*, row_number() OVER (PARTITION BY mention ORDER BY ord, entity_id) AS r FROM v JOIN g ON label = variant), p AS (SELECT mention, turn, g.*, row_number() OVER (PARTITION BY mention, turn ORDER BY ord, entity_id) AS r FROM v JOIN g ON starts_with(label, variant)),
np AS (SELECT mention, turn, count(*) AS k FROM p WHERE r <= 120 GROUP BY 1, 2), nx AS (SELECT mention, count(*) AS k FROM x WHERE r <= 1000 GROUP BY 1),
t AS (SELECT v.mention, v.turn, coalesce(nx.k, 0) + coalesce(sum(np.k) OVER (PARTITION BY v.mention ORDER BY v.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM v LEFT JOIN np ON np.mention = v.mention AND np.turn = v.turn LEFT JOIN nx ON nx.mention = v.mention),
a AS (SELECT mention, entity_id, label, score, sitelinks, dis FROM x WHERE r <= 1000 UNION SELECT p.mention, entity_id, label, score, sitelinks, dis FROM p JOIN t ON t.mention = p.mention AND t.turn = p.turn WHERE r <= 120 AND (t.turn = 0 OR had < 40)),
w AS (SELECT a.*, coalesce(stmts, 0) AS statement_count, lower(mention) AS lm, {_WORDS.format("label")} AS wl, {_WORDS.format("lower(mention)")} AS wm FROM a LEFT JOIN n USING (entity_id)),
s AS (SELECT *, round(1000 * CAST(label = lm AS INT) + 200 * CAST(starts_with(label, lm) AS INT) + 50 * CAST(contains(label, lm) AS INT) + 25 * len(list_intersect(wl, wm)) / greatest(1, len(list_distinct(list_concat(wl, wm)))) + score + ln(1 + sitelinks) + 8 * ln(1 + statement_count) - 400 * CAST(dis AS INT), 6) AS rank_score FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY rank_score DESC, statement_count DESC, score DESC, sitelinks DESC, length(label), entity_id) AS rank FROM s)
SELECT mention, entity_id, label, statement_count, rank_score, rank FROM o WHERE rank <= 20""")
def q22_graph_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by a graph store's label queries, counts of statements, and the remote ranker."""
    g, counts = graph(spark, sf_dir)
    names = table(spark, sf_dir, "part").select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(1)), F.upper("p_name"))).alias("mention"))
    return linking.graph_candidates(names, g, counts, 20).select("mention", "entity_id", "label", "statement_count", "rank_score", "rank")


_LABELS = "CASE WHEN p_size % 10 = 0 THEN '' ELSE p_name END"


@query(f"""WITH i AS (SELECT p_name AS mention, p_partkey, p_size, p_brand, {_LABELS} AS label, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS rank FROM part WHERE p_partkey % 9 > 0)
SELECT mention, rank, '<' || CASE WHEN label = '' THEN 'Q' || p_partkey ELSE label END || ' [DESCRIPTION] ' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END || ' [TYPE] ' || CASE WHEN p_size % 3 > 0 AND p_size % 4 > 0 THEN 'type ' || p_size ELSE 'owl#Thing' END || '>' AS candidate FROM i WHERE rank <= 20""")
def q23_search_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from a search service's recorded answers, types looked up once per id."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    item = F.struct(F.col("p_partkey").alias("ord"), F.concat(F.when(F.col("p_partkey") % 9 == 0, "P").otherwise("Q"), "p_partkey").alias("id"), F.when(size % 10 == 0, "").otherwise(F.col("p_name")).alias("label"), F.when(size % 2 == 0, F.col("p_brand")).alias("description"))
    recorded = p.groupBy(F.col("p_name").alias("request")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("search"))).alias("response"))
    items = remote.search_items(recorded, "request", "response").withColumnRenamed("request", "mention")
    details = p.select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.when(size % 3 > 0, F.concat(F.lit("Q90"), size)).alias("p31"))
    labels = p.select(F.concat(F.lit("Q90"), size).alias("p31"), F.when(size % 4 > 0, F.concat(F.lit("type "), size)).alias("type_label")).distinct()
    return linking.typed_candidates(items, details, labels)


_MERGE = """k AS (SELECT c_custkey, c_nationkey, c_name, c_custkey % 23 AS n FROM customer),
l AS (SELECT c_custkey, list('<' || n_name || ' [DESCRIPTION] d [TYPE] t>' ORDER BY i) AS c FROM (SELECT *, unnest(range(n)) AS i FROM k) JOIN nation ON n_nationkey = (c_nationkey + i) % 25 GROUP BY 1),
d AS (SELECT k.*, coalesce(c, []) AS c, CASE WHEN k.c_custkey % 11 = 0 THEN 'nil' ELSE '<' || g.n_name || ' [DESCRIPTION] d [TYPE] t>' END AS gold, CASE WHEN k.c_custkey % 7 = 0 THEN n + 1 ELSE n END AS asked FROM k LEFT JOIN l USING (c_custkey) JOIN nation g ON g.n_nationkey = (c_nationkey + k.c_custkey % 5) % 25),
a AS (SELECT *, asked = n AS parsed, CASE WHEN gold <> 'nil' AND NOT list_contains(c, gold) THEN list_append(c, gold) ELSE c END AS c2 FROM d)"""
_QUESTION = "'The selected entity mention in the table cell is: ' || c_name || '. The column name for ''' || c_name || ''' is Name. The referent entity candidates are: ' || {} || ' What is the correct referent entity for the entity mention ''' || c_name || '''?'"


def _nation_texts(spark: SparkSession, sf_dir: str) -> Column:
    """The 25 nations as one array of candidate texts."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    return F.array(*(F.lit(f"<{n} [DESCRIPTION] d [TYPE] t>") for n in names))


def merge_input(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Shard rows (shard, ord, question, output) and their audit rows (shard, ord, candidate_count)."""
    texts = _nation_texts(spark, sf_dir)
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    n = (key % 23).cast("int")
    c = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.get(texts, ((nation + i) % 25).cast("int")))).otherwise(F.array().cast("array<string>"))
    gold = F.when(key % 11 == 0, "nil").otherwise(F.get(texts, ((nation + key % 5) % 25).cast("int")))
    k = table(spark, sf_dir, "customer").withColumn("shard", key % 4).withColumn("ord", key)
    data = k.select("shard", "ord", text.question(F.col("c_name"), F.lit("Name"), c).alias("question"), gold.alias("output"))
    return data, k.select("shard", "ord", F.when(key % 7 == 0, n + 1).otherwise(n).alias("candidate_count"))


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    data, audit = merge_input(spark, sf_dir)
    return merging.rewrite_candidates(merging.zip_rows(data, audit, ["shard", "ord"]))


@query(f"""WITH {_MERGE}, u AS (SELECT c_custkey, unnest(c2) AS x, unnest(range(len(c2))) AS i FROM a), sh AS (SELECT c_custkey, string_agg(x, ', ' ORDER BY md5('42|' || c_custkey || '|' || x || '|' || i)) AS s FROM u GROUP BY 1)
SELECT c_custkey AS ord, md5({_QUESTION.format("CASE WHEN parsed THEN coalesce(s, '') ELSE array_to_string(c, ', ') END")}) AS digest, parsed AND len(c2) > len(c) AS added_gold, parsed AND len(c2) > 1 AS shuffled, parsed, parsed AND len(c2) > 21 AS over_limit FROM a LEFT JOIN sh USING (c_custkey)""")
def q6_rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards zipped with their audit rows; gold answers put in, candidates in random order, odd rows passed on."""
    return rewritten(spark, sf_dir).select("ord", F.md5("question").alias("digest"), "added_gold", "shuffled", "parsed", "over_limit")


@query(f"""WITH {_MERGE} SELECT count(*) AS n, count(*) FILTER (parsed AND len(c2) > len(c)) AS added_gold, count(*) FILTER (parsed AND len(c2) > 1) AS shuffled, count(*) FILTER (NOT parsed) AS parse_failed, count(*) FILTER (parsed AND len(c2) > 21) AS over_limit FROM a""")
def a17_merge_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.counters(rewritten(spark, sf_dir), added_gold=F.col("added_gold"), shuffled=F.col("shuffled"), parse_failed=~F.col("parsed"), over_limit=F.col("over_limit"))


_GRAMS = "list_concat(CASE WHEN length(x) <= 3 THEN [x] ELSE list_transform(range(1, length(x) - 1), lambda i: x[i:i+2]) END, CASE WHEN length(x) <= 4 THEN [x] ELSE list_transform(range(1, length(x) - 2), lambda i: x[i:i+3]) END)"


_HARD = f"""{_MERGE}, tx AS (SELECT DISTINCT '<' || n_name || ' [DESCRIPTION] d [TYPE] t>' AS t FROM nation), gr AS (SELECT t, unnest({_GRAMS}) AS gram FROM (SELECT t, lower(t[2:-2]) AS x FROM tx)), ct AS (SELECT t, gram, count(*) AS n FROM gr GROUP BY 1, 2), sz AS (SELECT t, sqrt(sum(n * n)) AS size FROM ct GROUP BY 1),
co AS (SELECT p.t AS a, q.t AS b, round(sum(p.n * q.n) / (any_value(sp.size) * any_value(sq.size)), 9) AS cosine FROM ct p JOIN ct q USING (gram) JOIN sz sp ON sp.t = p.t JOIN sz sq ON sq.t = q.t GROUP BY 1, 2),
u AS (SELECT c_custkey, gold, unnest(c) AS x, unnest(range(len(c))) AS i FROM d), f AS (SELECT c_custkey, gold, x, min(i) AS i FROM u WHERE x <> gold GROUP BY 1, 2, 3),
r AS (SELECT f.*, row_number() OVER (PARTITION BY c_custkey ORDER BY coalesce(cosine, 0) DESC, i) AS r FROM f LEFT JOIN co ON co.a = f.x AND co.b = f.gold),
o AS (SELECT c_custkey, [gold] || coalesce(list(x ORDER BY r) FILTER (r <= 19), []) AS picked FROM (SELECT c_custkey, gold FROM d) LEFT JOIN (SELECT c_custkey, x, r FROM r) USING (c_custkey) GROUP BY c_custkey, gold),
w AS (SELECT c_custkey, unnest(picked) AS x, unnest(range(len(picked))) AS i FROM o), sh AS (SELECT c_custkey, string_agg(x, ', ' ORDER BY md5('42|' || c_custkey || '|' || x || '|' || i)) AS s, count(*) AS n_candidates FROM w GROUP BY 1),
hard AS (SELECT c_custkey AS ord, c_nationkey AS tab, n_candidates, md5({_QUESTION.format("s")}) AS digest FROM d JOIN sh USING (c_custkey))"""


@query(f"WITH {_HARD} SELECT ord, n_candidates, digest FROM hard")
def t28_hard_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions rebuilt with the gold answer and the 19 candidates most like it, in random order."""
    data, _ = merge_input(spark, sf_dir)
    # The choice depends on the list and the gold answer alone; it is made once for each two of them.
    lists = data.withColumn("given", text.question_candidates(F.col("question")))
    same = lists.select(F.col("given").alias("__given"), F.col("output").alias("__gold")).distinct()
    picks = same.select("*", scoring.hard_negatives(F.col("__given"), F.col("__gold"), 19).alias("c"))
    d = lists.join(picks, F.col("given").eqNullSafe(F.col("__given")) & F.col("output").eqNullSafe(F.col("__gold"))).withColumn("c", sampling.shuffled(F.col("c"), 42, F.col("ord")))
    return d.select("ord", F.size("c").cast("long").alias("n_candidates"), F.md5(text.with_candidates(F.col("question"), F.col("c"))).alias("digest"))


@query(f"""WITH {_HARD}, tb AS (SELECT tab, min(ord) AS first, max(ord) AS last FROM hard GROUP BY 1), cut AS (SELECT first FROM tb ORDER BY first LIMIT 1 OFFSET 10), lt AS (SELECT tab, last FROM tb ORDER BY last DESC LIMIT 5)
SELECT 'train' AS split, tab, ord, digest FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY md5('42|' || ord)) AS r FROM hard WHERE ord < (SELECT first FROM cut)) WHERE r = 1
UNION ALL SELECT 'val', tab, ord, digest FROM (SELECT *, row_number() OVER (PARTITION BY tab ORDER BY md5('7|' || ord)) AS r FROM hard WHERE tab IN (SELECT tab FROM lt)) WHERE r = 1
UNION ALL SELECT 'eval', hard.tab, ord, digest FROM hard JOIN lt ON ord = last""")
def q8_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows of the first ten tables, validation rows of the last five, evaluation on their last rows, all with
    their candidates rebuilt round the gold answer."""
    data, _ = merge_input(spark, sf_dir)
    tab = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("tab"))
    rows = data.join(tab, "ord").select("tab", "ord", "question", "output")
    last = sampling.last_tables(rows, "tab", 5)
    parts = {
        "train": sampling.one_per_group(sampling.first_tables(rows, "tab", 10), ["tab"], "ord"), "val": sampling.one_per_group(last, ["tab"], "ord", seed=7),
        "eval": last.groupBy("tab").agg(F.max_by(F.struct("ord", "question", "output"), "ord").alias("r")).select("tab", "r.*"),
    }
    out = None
    for name, part in parts.items():
        c = sampling.shuffled(scoring.hard_negatives(text.question_candidates(F.col("question")), F.col("output"), 19), 42, F.col("ord"))
        one = part.select(F.lit(name).alias("split"), "tab", "ord", F.md5(text.with_candidates(F.col("question"), c)).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out
