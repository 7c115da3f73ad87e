"""Knowledge base, mention jobs and candidates over the star schema: parts are entities, their names mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import scoring, text
from cellweave.operators import knowledge, retrieval, sampling, tables
from cellweave.plans.registry import query, table

FLAGSHIP = "q4_candidates"

_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_KB = f"kb AS (SELECT 'Q' || p_partkey AS qid, p_partkey AS ord, p_name AS label, p_brand || ' size ' || p_size AS description, p_type AS p31_label, {_NORM.format('p_name')} AS norm FROM part)"
_JOBS = f"jobs AS (SELECT {_NORM.format('p_name')} AS mention_norm, 'Q' || p_partkey AS gold_qid, l_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey)"
_PRIOR = "c AS (SELECT mention_norm, gold_qid AS qid, count(*) AS n FROM jobs GROUP BY 1, 2), prior AS (SELECT *, n / max(n) OVER (PARTITION BY mention_norm) AS prior FROM c)"


def kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"), F.concat("p_brand", F.lit(" size "), "p_size").alias("description"),
        F.col("p_type").alias("p31_label"), F.lit("").alias("enwiki_title"), F.array("p_brand").alias("aliases"), text.normalize_text(F.col("p_name"), ascii_only=True).alias("norm"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", text.normalize_text(F.col("p_name"), ascii_only=True).alias("mention_norm"))
    return li.join(p, li.l_partkey == p.p_partkey).select("mention_norm", F.concat(F.lit("Q"), "p_partkey").alias("gold_qid"), "l_suppkey")


def ranked(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    entities, mentions = kb(spark, sf_dir), jobs(spark, sf_dir)
    aliases = entities.select(F.col("norm").alias("alias_norm"), "qid", "ord")
    # Entities are looked up once per distinct mention, not once per job.
    hits = retrieval.exact(mentions, aliases).join(retrieval.prior(mentions).drop("n"), ["mention_norm", "qid"], "left")
    pairs = hits.join(entities, "qid")
    context = F.array(F.lit("brand"), F.lit("size"), F.lit("10"))
    features = {
        "exact": (F.col("norm") == F.col("mention_norm")).cast("double"), "contains": F.contains("norm", F.col("mention_norm")).cast("double"),
        "sim": scoring.similarity(F.col("mention_norm"), F.col("norm")), "prior": F.coalesce("prior", F.lit(0.0)),
        "ctx": scoring.jaccard(F.array_distinct(text.tokens(text.normalize_text(F.col("description"), ascii_only=True))), context),
    }
    return retrieval.rank_candidates(pairs.drop("rank"), features, ["mention_norm"], k, [F.col("ord")])


_RANKED = f"""
{_KB}, {_JOBS}, {_PRIOR},
e AS (SELECT m.mention_norm, kb.*, row_number() OVER (PARTITION BY m.mention_norm ORDER BY ord, qid) AS r FROM (SELECT DISTINCT mention_norm FROM jobs) m JOIN kb ON kb.norm = m.mention_norm),
f AS (SELECT e.*, coalesce(p.prior, 0) AS prior, list_filter(string_split({_NORM.format("description")}, ' '), lambda x: x <> '') AS w FROM e LEFT JOIN prior p ON p.mention_norm = e.mention_norm AND p.qid = e.qid WHERE r <= 80),
s AS (SELECT *, round(3.8 + 1.3 + 2.3 + 1.8 * prior + 0.9 * (len(list_intersect(w, ['brand', 'size', '10'])) / greatest(1, len(list_distinct(list_concat(w, ['brand', 'size', '10']))))), 6) AS score FROM f),
t AS (SELECT *, row_number() OVER (PARTITION BY mention_norm ORDER BY score DESC, ord) AS rank FROM s)
"""


@query(f"WITH {_RANKED} SELECT mention_norm, qid, rank, score, '<' || label || ' [DESCRIPTION] ' || description || ' [TYPE] ' || p31_label || '>' AS candidate FROM t WHERE rank <= 20")
def q4_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = text.candidate_text(F.col("label"), F.col("qid"), F.col("description"), F.col("p31_label"))
    return ranked(spark, sf_dir).select("mention_norm", "qid", F.col("rank").cast("long").alias("rank"), "score", name.alias("candidate"))


@query(f"""WITH {_RANKED}, k AS (SELECT mention_norm, qid FROM t WHERE rank <= 20)
SELECT (k.qid IS NOT NULL) AS gold_in_topk, count(*) AS n FROM jobs LEFT JOIN k ON k.mention_norm = jobs.mention_norm AND k.qid = jobs.gold_qid GROUP BY 1""")
def a18_gold_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = ranked(spark, sf_dir).select("mention_norm", F.col("qid").alias("gold_qid"), F.lit(True).alias("hit"))
    return jobs(spark, sf_dir).join(top, ["mention_norm", "gold_qid"], "left").groupBy(F.coalesce("hit", F.lit(False)).alias("gold_in_topk")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_JOBS}, {_PRIOR} SELECT mention_norm, qid, n, round(prior, 6) AS prior FROM prior")
def a1_mention_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prior(jobs(spark, sf_dir)).select("mention_norm", "qid", "n", F.round("prior", 6).alias("prior"))


@query(f"""WITH {_KB}, a AS (SELECT norm AS alias_norm, qid, 'label' AS source FROM kb UNION ALL SELECT {_NORM.format("p_brand")}, 'Q' || p_partkey, 'alias' FROM part)
SELECT alias_norm, source, count(*) AS n_entities, min(qid) AS least FROM a WHERE alias_norm <> '' GROUP BY 1, 2""")
def q1_alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = knowledge.alias_index(kb(spark, sf_dir), ascii_only=True)
    return index.groupBy("alias_norm", "source").agg(F.count(F.lit(1)).alias("n_entities"), F.min("qid").alias("least"))


@query(f"""WITH {_KB}, m AS (SELECT DISTINCT split_part(norm, ' ', 1) AS mention_norm FROM kb),
h AS (SELECT mention_norm, qid, row_number() OVER (PARTITION BY mention_norm ORDER BY ord, qid) AS rank FROM m JOIN kb ON starts_with(norm, mention_norm))
SELECT mention_norm, qid, rank FROM h WHERE rank <= 20""")
def j2_prefix_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = kb(spark, sf_dir)
    mentions = entities.select(F.split_part("norm", F.lit(" "), F.lit(1)).alias("mention_norm"))
    return retrieval.prefix(mentions, entities.select(F.col("norm").alias("alias_norm"), "qid", "ord"), limit=20).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH d AS (SELECT p_partkey, list_filter(string_split({_NORM.format("p_name || ' ' || p_brand || ' ' || p_type")}, ' '), lambda x: x <> '') AS w FROM part),
i AS (SELECT p_partkey, term, count(*) AS tf FROM (SELECT p_partkey, unnest(w) AS term FROM d) GROUP BY 1, 2),
s AS (SELECT count(*) AS n, avg(len(w)) AS average FROM d), f AS (SELECT term, count(*) AS df FROM i GROUP BY 1),
m AS (SELECT DISTINCT {_NORM.format("p_type || ' ' || p_brand")} AS mention_norm FROM part),
q AS (SELECT mention_norm, term, count(*) AS times FROM (SELECT mention_norm, unnest(string_split(mention_norm, ' ')[1:8]) AS term FROM m) GROUP BY 1, 2),
b AS (SELECT mention_norm, 'Q' || p_partkey AS qid, round(sum(times * greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / average))), 9) AS bm25
  FROM q JOIN f USING (term) JOIN i USING (term) JOIN d USING (p_partkey), s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY mention_norm ORDER BY bm25 DESC, qid) AS rank FROM b)
SELECT mention_norm, qid, round(bm25, 6) AS bm25, rank FROM r WHERE rank <= 10""")
def j3_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    norm = lambda *c: text.normalize_text(F.concat_ws(" ", *c), ascii_only=True)
    docs = p.select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), norm("p_name", "p_brand", "p_type").alias("body"))
    hits = retrieval.full_text(p.select(norm("p_type", "p_brand").alias("mention_norm")), docs, limit=10)
    return hits.select("mention_norm", "qid", F.round("bm25", 6).alias("bm25"), F.col("rank").cast("long").alias("rank"))


@query("""WITH n AS (SELECT 'N' || n_nationkey AS qid, n_name AS label, 'R' || n_regionkey AS p31 FROM nation UNION ALL SELECT 'R' || r_regionkey, r_name, '' FROM region)
SELECT a.qid, a.label, coalesce(b.label, '') AS p31_label FROM n a LEFT JOIN n b ON a.p31 = b.qid""")
def j6_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("qid"), F.col("n_name").alias("label"), F.concat(F.lit("R"), "n_regionkey").alias("p31"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("qid"), F.col("r_name").alias("label"), F.lit("").alias("p31"))
    return knowledge.with_type_label(n.unionByName(r)).select("qid", "label", "p31_label")


@query("""SELECT 'Q' || n_nationkey AS qid, n_name AS label, 'nation of ' || r_name AS description, 'Q' || (100 + n_regionkey) AS p31, lower(n_name) AS aliases, 1 AS popularity, 2 AS statement_count
FROM nation JOIN region ON n_regionkey = r_regionkey""")
def s4_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knowledge from N-Triples: lines are written from nations, then parsed and assembled."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    line = lambda p, o: F.concat(F.lit("<http://x/entity/Q"), "n_nationkey", F.lit("> <"), F.lit(p), F.lit("> "), o, F.lit(" ."))
    lit = lambda c, lang="@en": F.concat(F.lit('"'), c, F.lit(f'"{lang}'))
    iri = lambda c: F.concat(F.lit("<http://x/entity/Q"), c, F.lit(">"))
    rows = F.array(
        line("http://schema.org/name", lit(F.col("n_name"), "@fr")), line("http://schema.org/name", lit(F.col("n_name"))), line("http://schema.org/description", lit(F.concat(F.lit("nation of "), "r_name"))),
        line("http://www.w3.org/2004/02/skos/core#altLabel", lit(F.lower("n_name"))), line("http://x/prop/direct/P31", iri(F.col("n_regionkey") + 100)), line("http://x/prop/direct/P31", iri(F.col("n_regionkey") + 200)),
        line("http://x/prop/direct/P17", iri(F.lit(7))), line("http://schema.org/about", iri(F.lit(8))), F.lit("# no triple"),
    )
    lines = n.select("n_nationkey", F.posexplode(rows).alias("nth", "value")).select((F.col("n_nationkey") * 100 + F.col("nth")).alias("ord"), "value")
    e = knowledge.assemble(knowledge.parse_triples(lines), "http://schema.org/name", "http://schema.org/description", "http://www.w3.org/2004/02/skos/core#altLabel", "http://x/prop/direct/")
    return e.select("qid", "label", "description", "p31", F.array_join("aliases", "|").alias("aliases"), F.col("popularity").cast("int").alias("popularity"), F.col("statement_count").cast("int").alias("statement_count"))


@query("SELECT 'Q' || s_suppkey AS qid, s_name AS label, 'Q' || s_nationkey AS p31, 2 AS popularity, 1 AS statement_count, 't' || s_suppkey AS enwiki_title FROM supplier")
def s2_entity_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities from a JSON dump: lines of an array, with a bad one, are written from suppliers, then parsed."""
    s = table(spark, sf_dir, "supplier")
    whole = F.format_string('{"id":"Q%s","labels":{"en":{"value":"%s"}},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q%s"}}}}]},"sitelinks":{"enwiki":{"title":"t%s"},"dewiki":{"title":"u"}}},', "s_suppkey", "s_name", "s_nationkey", "s_suppkey")
    lines = s.select(F.explode(F.array(F.lit("["), whole, F.lit("{bad"))).alias("value"))
    return knowledge.parse_entities(lines).select("qid", "label", "p31", F.col("popularity").cast("int").alias("popularity"), F.col("statement_count").cast("int").alias("statement_count"), "enwiki_title")


_ORDERED = "SELECT l_suppkey, p_name, p_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) AS r FROM lineitem JOIN part ON l_partkey = p_partkey"


def supplier_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One web table per supplier: a header and a row per line, the part's cell linked."""
    li, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    rows = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "p_name", "p_partkey"))).alias("rows"))
    matrix = lambda head, cells: F.concat(F.array(F.array(*map(F.lit, head))), F.transform("rows", cells))
    return rows.select(
        F.concat(F.lit("s"), "l_suppkey", F.lit(".json")).alias("source_file"), matrix(["Part", "Note"], lambda r: F.array(r["p_name"], F.lit(""))).alias("text"),
        matrix(["", ""], lambda r: F.array(r["p_name"], F.lit(""))).alias("link"), matrix(["", ""], lambda r: F.array(F.concat(F.lit("Q"), r["p_partkey"]), F.lit(""))).alias("entity"), F.lit("None").alias("caption"),
    )


@query(f"SELECT 's' || l_suppkey || '.json#' || r || ':0' AS job_id, p_name AS mention, 'Part' AS column_name, 'Q' || p_partkey AS gold_qid, '' AS caption FROM ({_ORDERED})")
def q2_mention_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.mention_jobs(supplier_tables(spark, sf_dir)).select("job_id", "mention", "column_name", "gold_qid", "caption")


@query(f"""WITH o AS ({_ORDERED}), g AS (SELECT l_suppkey, list(p_name ORDER BY r) AS names FROM o GROUP BY 1), j AS (SELECT l_suppkey, names, unnest(range(len(names))) AS pos FROM g)
SELECT 's' || l_suppkey || '.json' AS source_file, pos AS row_index, array_to_string(CASE WHEN len(names) <= 10 THEN names ELSE names[greatest(0, least(pos - 4, len(names) - 10)) + 1 : greatest(0, least(pos - 4, len(names) - 10)) + 10] END, '|') AS shifted,
  array_to_string(names[greatest(0, pos - 4) + 1 : pos + 6], '|') AS clipped FROM j""")
def w1_row_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = supplier_tables(spark, sf_dir).select("source_file", F.transform(F.slice("text", 2, 1_000_000_000), lambda r: r[0]).alias("names"))
    # Both windows are cut before the explode, so a row takes twenty names along and not the whole column.
    cut = lambda names: F.transform(names, lambda x, i: F.struct(tables.shifted_window(names, i).alias("s"), tables.clipped_window(names, i).alias("c")))
    t = t.select("source_file", F.posexplode(text.let(F.col("names"), cut)).alias("at", "w"))
    return t.select("source_file", F.col("at").cast("long").alias("row_index"), F.array_join("w.s", "|").alias("shifted"), F.array_join("w.c", "|").alias("clipped"))


@query(f"SELECT 's' || l_suppkey || '.json' AS source_file, arg_min('s' || l_suppkey || '.json#' || r || ':0', md5('42|' || 's' || l_suppkey || '.json#' || r || ':0')) AS job_id FROM ({_ORDERED}) GROUP BY l_suppkey")
def q3_one_job_per_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = tables.mention_jobs(supplier_tables(spark, sf_dir)).select("source_file", "job_id")
    return sampling.one_per_group(j, ["source_file"], "job_id").select("source_file", "job_id")


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def p4_page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.page_title(F.col("html")).alias("title"))


@query("""WITH d AS (SELECT doc_id, lower(text) AS low, lower(source) AS title FROM documents),
s AS (SELECT doc_id, CASE WHEN contains(low, 'the ') THEN 2 ELSE 0 END + CASE WHEN contains(low, title) THEN 3 ELSE 0 END + CASE WHEN doc_id % 3 = 0 THEN 0.2 ELSE 0 END AS body,
  CASE WHEN contains(title, 'the ') THEN 2 ELSE 0 END + 3 + CASE WHEN doc_id % 2 = 0 THEN 0.2 ELSE 0 END - CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 0 END AS other FROM d)
SELECT doc_id, CASE WHEN greatest(body, other) <= 0 THEN '' WHEN body >= other THEN 'Body' ELSE 'Other' END AS section FROM s""")
def p5_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions, link titles and table openers decide between two sections; blank and page sections don't count."""
    d = table(spark, sf_dir, "documents")
    mark = lambda c: F.when(c, " {| x").otherwise("")
    body = F.concat(F.coalesce("text", F.lit("")), mark(F.col("doc_id") % 3 == 0))
    other = F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("-")).otherwise(F.col("source")), mark(F.col("doc_id") % 2 == 0))
    context = F.create_map(F.lit("null"), F.lit("<title>the x</title>"), F.lit(" "), F.lit("the the {|"), F.lit("Body"), body, F.lit("Other"), other)
    return d.select("doc_id", tables.section_of(context, F.lit("the "), F.replace("source", F.lit(" "), F.lit("_"))).alias("section"))


@query("""WITH b AS (SELECT DISTINCT p_name AS a FROM part), g AS (SELECT a, unnest(list_concat(list_transform(range(1, length(a) - 1), lambda i: a[i:i+2]), list_transform(range(1, length(a) - 2), lambda i: a[i:i+3]))) AS gram FROM b),
c AS (SELECT a, gram, count(*) AS n FROM g GROUP BY 1, 2), l AS (SELECT a, sqrt(sum(n * n)) AS size FROM c GROUP BY 1),
p AS (SELECT x.a, y.a AS other, round(sum(x.n * y.n) / (any_value(lx.size) * any_value(ly.size)), 6) AS cosine FROM c x JOIN c y ON x.gram = y.gram AND x.a <> y.a JOIN l lx ON lx.a = x.a JOIN l ly ON ly.a = y.a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, other) AS rank FROM p) SELECT a AS gold, other AS negative, cosine, rank FROM r WHERE rank <= 5""")
def t28_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names closest to each name by cosine of character 3- and 4-grams."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("a")).distinct()
    grams = names.select("a", F.explode(scoring.char_ngrams(F.col("a"))).alias("gram")).groupBy("a", "gram").agg(F.count(F.lit(1)).alias("n"))
    size = grams.groupBy("a").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("size"))
    left, right = grams.join(size, "a"), grams.join(size, "a").select(F.col("a").alias("other"), "gram", F.col("n").alias("m"), F.col("size").alias("other_size"))
    pairs = left.join(right, "gram").where(F.col("a") != F.col("other")).groupBy("a", "other", "size", "other_size").agg(F.sum(F.col("n") * F.col("m")).alias("dot"))
    pairs = pairs.select(F.col("a").alias("gold"), F.col("other").alias("negative"), F.round(F.col("dot") / (F.col("size") * F.col("other_size")), 6).alias("cosine"))
    return retrieval.top(pairs, ["gold"], [F.col("cosine").desc(), F.col("negative")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("""SELECT 'Q' || p_partkey AS qid, round(1000 * CAST(p_name = 'cold widget' AS INT) + 200 * CAST(starts_with(p_name, 'cold') AND starts_with(p_name, 'cold widget') AS INT) + 50 * CAST(contains(p_name, 'cold widget') AS INT)
  + 25 * len(list_intersect(string_split(p_name, ' '), ['cold', 'widget'])) / greatest(1, len(list_distinct(list_concat(string_split(p_name, ' '), ['cold', 'widget'])))) + p_size + ln(1 + p_size) + 8 * ln(1 + p_partkey) - 400 * CAST(contains(lower(p_type), 'disambiguation') AS INT), 6) AS rank_score FROM part""")
def m6_remote_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    score = scoring.remote_rank(F.col("p_name"), F.lit("cold widget"), F.col("p_size"), F.col("p_size"), F.col("p_partkey"), scoring.is_disambiguation(F.lit(""), F.col("p_type")))
    return p.select(F.concat(F.lit("Q"), "p_partkey").alias("qid"), F.round(score, 6).alias("rank_score"))
