"""Text measures and sampling over documents, pages, benchmark passages and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import reasoning, scoring, text
from cellweave.operators import merging, metrics, retrieval, sampling
from cellweave.plans.registry import query, table

_BROADCAST_PASSAGES = 10_000  # short passages sent to all tasks; more meet the texts in a Cartesian product
_CLEAN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_WORDS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, length({_CLEAN.format('text')}) AS n_chars, md5({_CLEAN.format('text')}) AS digest FROM documents")
def t1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), F.md5(c).alias("digest"))


@query("""WITH w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '\\([^)]*\\)', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct FROM w""")
def t3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", text.tokens(text.normalize_text(F.col("text"), ascii_only=True)).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(text, '([.!?。！？])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))), lambda x: x <> '') AS s FROM documents)
SELECT doc_id, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM s""")
def t15_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", reasoning.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), g AS (SELECT doc_id, w, list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) AS g FROM w)
SELECT doc_id, CASE WHEN len(w) <= 3 THEN 0.0 ELSE round(1.0 - len(list_distinct(g)) / len(g), 6) END AS repeat_ratio, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(1, CAST(floor(len(w) * 1.3) AS INT)) END AS n_tokens FROM g""")
def t17_repeat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(reasoning.repeat_ratio(F.col("text"), 3), 6).alias("repeat_ratio"), reasoning.estimated_tokens(F.col("text")).alias("n_tokens"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), k AS (SELECT doc_id, line, i, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) AS key FROM l),
f AS (SELECT doc_id, key, arg_min(line, i) AS line, min(i) AS i FROM k WHERE key <> '' GROUP BY 1, 2) SELECT doc_id, count(*) AS n_kept, md5(string_agg(line, '|' ORDER BY i)) AS digest FROM f GROUP BY 1""")
def u6_distinct_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of each text's lines that are equal up to case and white space."""
    d = table(spark, sf_dir, "documents").select("doc_id", reasoning.distinct_sentences(F.split("text", "\n")).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").cast("long").alias("n_kept"), F.md5(F.array_join("s", "|")).alias("digest"))


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def p20_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage. A hash of the passage's words two to six makes it an equi-join; passages
    without six words and one more are looked for in every text."""
    def grams(words):
        return F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, 5))))

    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"), F.split("text", " ").alias("w"))
    # Inside a passage every word from the second to the one before the last stands between the same blanks in a text.
    short = b.where(F.size("w") < 7).select("item_id", "passage")
    b = b.where(F.size("w") >= 7).select("item_id", "passage", F.xxhash64(*(F.get("w", F.lit(j)) for j in range(1, 6))).alias("g"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = docs.select("doc_id", "text", F.split("text", " ").alias("w"), F.spark_partition_id().alias("p"))
    d = d.select("doc_id", "text", grams(F.col("w")).alias("g"), F.spark_partition_id().alias("p"))
    d = d.select("doc_id", "text", F.explode(F.array_distinct("g")).alias("g"))
    found = d.join(b, "g").where(F.contains("text", F.col("passage"))).select("item_id", "doc_id")
    if n := short.count():
        found = found.unionByName(docs.join(F.broadcast(short) if n <= _BROADCAST_PASSAGES else short, F.contains("text", F.col("passage"))).select("item_id", "doc_id"))
    return found.distinct()


@query("""WITH v AS (SELECT label, min(vec_id) AS gold FROM embeddings GROUP BY 1), g AS (SELECT v.label, e.embedding AS ge, v.gold FROM v JOIN embeddings e ON e.vec_id = v.gold),
s AS (SELECT e.label, vec_id, round(list_dot_product(embedding::DOUBLE[], ge::DOUBLE[]) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) * list_dot_product(ge::DOUBLE[], ge::DOUBLE[])), 5) AS cosine FROM embeddings e JOIN g ON e.label = g.label WHERE vec_id <> gold),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cosine DESC, vec_id) AS rank FROM s) SELECT label, vec_id, cosine, rank FROM r WHERE rank <= 5""")
def o3_similar_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    gold = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("g")).select("label", F.col("g.vec_id").alias("gold"), F.col("g.embedding").alias("of"))
    s = e.join(gold, "label").where(F.col("vec_id") != F.col("gold")).select("label", "vec_id", F.round(scoring.cosine(F.col("embedding"), F.col("of")), 5).alias("cosine"))
    return retrieval.top(s, ["label"], [F.col("cosine").desc(), F.col("vec_id")], 5).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH t AS (SELECT source, min(doc_id) AS f FROM documents GROUP BY 1 ORDER BY f LIMIT 11), c AS (SELECT CASE WHEN count(*) > 10 THEN max(f) END AS cut FROM t)
SELECT source, arg_min(doc_id, md5('42|' || doc_id)) AS doc_id FROM documents, c WHERE cut IS NULL OR doc_id < cut GROUP BY 1""")
def r3_first_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.one_per_group(sampling.first_tables(d, "source", 10, "doc_id"), ["source"], "doc_id")


@query("""WITH t AS (SELECT source, max(doc_id) AS l FROM documents GROUP BY 1 ORDER BY l DESC LIMIT 5) SELECT source, max(doc_id) AS doc_id, count(*) AS n FROM documents WHERE source IN (SELECT source FROM t) GROUP BY 1""")
def r5_last_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.last_tables(d, "source", 5, "doc_id").groupBy("source").agg(F.max("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)
SELECT doc_id, r <= greatest(1, CAST(round_even(n * 0.05, 0) AS BIGINT)) AS is_eval FROM r""")
def r7_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.05, seed=7)


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w)
SELECT doc_id, string_agg(x, ' ' ORDER BY md5('42|' || doc_id || '|' || x || '|' || i)) AS shuffled FROM i GROUP BY 1""")
def r6_shuffled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(sampling.shuffled(F.split("text", " "), 42, F.col("doc_id")), " ").alias("shuffled"))


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 200")
def r8_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 200)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 = 1 AND doc_id >= 41 ORDER BY doc_id LIMIT 50")
def s10_sharded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id").where(sampling.shard(F.col("doc_id"), 4, 1))
    return d.orderBy("doc_id").offset(10).limit(50)


@query("""WITH c AS (SELECT source, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, max(n_chars) FILTER (r = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT)) AS p50, max(n_chars) FILTER (r = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)) AS p90, max(n_chars) FILTER (r = CAST(round_even(0.99 * (n - 1), 0) AS BIGINT)) AS p99 FROM c GROUP BY 1""")
def a10_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, sf_dir, "documents"), "n_chars", [0.5, 0.9, 0.99], ["source"])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang, doc_id, n_chars FROM r WHERE r <= 3""")
def k9_samples_per_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.per_group(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), "lang", "doc_id", 3)


@query("SELECT 0 AS source, * FROM (SELECT doc_id AS ord, text AS body FROM documents ORDER BY doc_id LIMIT 30) UNION ALL SELECT 1, * FROM (SELECT page_id, url FROM pages ORDER BY page_id LIMIT 20)")
def q10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("body"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("url").alias("body"))
    return merging.union_in_order([d, p], "ord", [30, 20]).select("source", "ord", "body")
