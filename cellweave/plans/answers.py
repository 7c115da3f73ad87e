"""Extraction of answers, and training data over the predictor seam, with stub models whose answers SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import extraction as X
from cellweave.functions import reasoning as R
from cellweave.functions import text
from cellweave.operators import metrics, mining, sampling, tables
from cellweave.plans.reasoning import _THOUGHTS, thoughts
from cellweave.plans.registry import query, table
from cellweave.plans.samples import _HEAD, _ROWS, segs

_NAMES = """k AS (SELECT c_custkey AS idx, c_name AS name, c_mktsegment AS seg, '<' || c_name || ' [DESC] ' || c_mktsegment || ' [TYPE] customer>' AS gold, '<' || c_name || ' [DESC] other [TYPE] customer>' AS wrong,
  '<' || c_name || ' [DESC] ' || c_mktsegment || ' and more [TYPE] customer>' AS longer FROM customer)"""


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    of = lambda d: F.concat(F.lit("<"), "name", F.lit(" [DESC] "), d, F.lit(" [TYPE] customer>"))
    return c.withColumns({"gold": of(F.col("seg")), "wrong": of(F.lit("other")), "longer": of(F.concat("seg", F.lit(" and more")))})


def cases(key: Column, of: int, values: dict[int, Column | str], otherwise: Column | str) -> Column:
    out = F.lit(otherwise) if isinstance(otherwise, str) else otherwise
    for k, v in values.items():
        out = F.when(key % of == k, F.lit(v) if isinstance(v, str) else v).otherwise(out)
    return out


@query(f"""WITH {_NAMES} SELECT idx,
  CASE idx % 8 WHEN 0 THEN '<the answer is ' || gold[2:-2] || '>' WHEN 1 THEN gold WHEN 2 THEN replace(gold, '[DESC]', '[DESCRIPTION]') WHEN 3 THEN '<other thing>' WHEN 4 THEN '' WHEN 5 THEN '<nothing here>' WHEN 6 THEN gold ELSE gold END AS candidate_entity,
  CASE idx % 8 WHEN 0 THEN gold WHEN 1 THEN gold WHEN 2 THEN gold WHEN 7 THEN longer ELSE '' END AS table_entity,
  CASE idx % 8 WHEN 0 THEN '' WHEN 1 THEN gold WHEN 2 THEN gold WHEN 3 THEN '<other thing>' WHEN 4 THEN '' WHEN 5 THEN '' ELSE gold END AS plain_entity,
  CASE idx % 8 WHEN 0 THEN 'the answer is ' || gold[2:-2] WHEN 1 THEN gold WHEN 2 THEN replace(gold, '[DESC]', '[DESCRIPTION]') WHEN 4 THEN '' WHEN 5 THEN 'nothing here' WHEN 7 THEN longer ELSE '<other thing>' END AS written_entity FROM k""")
def t32_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four extractors on answers with and without brackets, markers, echoes and candidates."""
    n = named(spark, sf_dir)
    inner = F.substring(F.col("gold"), F.lit(2), F.length("gold") - 2)
    body = cases(F.col("idx"), 8, {0: F.concat(F.lit("the answer  is "), inner), 1: F.concat("gold", F.lit(" tail")), 2: F.concat(F.replace("gold", F.lit("[DESC]"), F.lit("[DESCRIPTION]")), F.lit(".")), 3: "<other\nthing>", 4: "", 5: "nothing here", 6: F.concat(F.lit("<other thing>\n### Input:\n"), "gold")}, F.concat("longer", F.lit(" or "), "gold"))
    raw = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("<think>x</think> "), body)).otherwise(body)
    c = F.array("gold", "longer", "wrong")
    return n.select("idx", X.candidate_entity(raw, c).alias("candidate_entity"), X.table_entity(raw, c).alias("table_entity"), X.plain_entity(raw, c).alias("plain_entity"), X.written_entity(body).alias("written_entity"))


@query(f"WITH {_NAMES} SELECT idx, CASE WHEN idx % 2 = 0 THEN name || '|' || seg ELSE name END AS names FROM k")
def t24_candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(spark, sf_dir)
    second = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("< "), "seg", F.lit(" [description] b [TYPE] c>"))).otherwise("<x [DESC] b [TYPE] c> <no marker>")
    return n.select("idx", F.array_join(X.candidate_names(F.concat("gold", F.lit(", "), second)), "|").alias("names"))


_LINES = ["Row and  column match.", "It is the provided  correct answer.", "This is for verification only.", "<A [DESCRIPTION] b [TYPE] c> <D [DESCRIPTION] e [TYPE] f>", "So the referent entity candidates are listed.", " Candidates : "]


@query(f"""WITH {_NAMES}, r AS (SELECT *, CASE WHEN idx % 6 IN (0, 5) THEN 'Row and column match.' ELSE '' END AS a, CASE WHEN idx % 4 = 0 THEN name ELSE '' END AS b FROM k)
SELECT idx, a || CASE WHEN a <> '' AND b <> '' THEN chr(10) ELSE '' END || b AS sane, CASE WHEN a || b = '' THEN gold ELSE '<think>' || chr(10) || a || CASE WHEN a <> '' AND b <> '' THEN chr(10) ELSE '' END || b || chr(10) || '</think>' || chr(10) || gold END AS output FROM r""")
def t34_sane_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Giveaways, lists of candidates and their header go; what is left stands before the answer, if anything is."""
    line = lambda k: F.get(F.array(*map(F.lit, _LINES)), ((F.col("idx") + k) % 6).cast("int"))
    reasoning = F.concat(line(0), F.lit("\r\n\n"), line(1), F.lit("\n"), F.when(F.col("idx") % 4 == 0, F.col("name")).otherwise("We are given an entity linking task"))
    n = named(spark, sf_dir).withColumn("r", reasoning)
    return n.select("idx", R.sane_reasoning(F.col("r")).alias("sane"), R.augmented_output(F.col("r"), F.concat(F.lit(" "), "gold", F.lit("\n"))).alias("output"))


@query(f"WITH {_NAMES} SELECT idx, name AS chosen, seg AS rejected FROM k WHERE idx % 3 = 0")
def t42_shared_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    think = F.lit("<think>\n")
    n = named(spark, sf_dir).select("idx", F.concat(think, "name").alias("c"), F.when(F.col("idx") % 3 == 0, F.concat(think, "seg")).when(F.col("idx") % 3 == 1, F.col("seg")).otherwise(F.concat(F.lit("<think>"), "seg")).alias("r"))
    return n.select("idx", R.shared_prefix(F.col("c"), F.col("r")).alias("p")).where(F.col("p").isNotNull()).select("idx", "p.chosen", "p.rejected")


@query(f"""WITH k AS (SELECT *, least(n, 7) AS pos FROM ({_ROWS})), w AS (SELECT *, greatest(0, least(pos - 1 - 4, n - 10)) AS s FROM k)
SELECT c_nationkey, md5({_HEAD} || string_agg(CASE WHEN c_nationkey % 2 = 1 OR r = pos THEN 'row ' || r || ': | ' || c_name || ' | ' || c_mktsegment || ' |' ELSE 'row ' || r || ': ' || c_name END, ' [SEP] ' ORDER BY r) FILTER (c_nationkey % 2 = 1 OR n <= 10 OR (r > s AND r <= s + 10))) AS digest, '<a [DESC] b>' AS output FROM w GROUP BY c_nationkey""")
def t43_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as an evaluation sees them: the table cut round the entity, or whole if it isn't found, short markers."""
    s = segs(spark, sf_dir)
    mention = F.when(F.col("c_nationkey") % 2 == 0, F.get("rows", F.least(F.size("rows"), F.lit(7)) - 1)["c_name"]).otherwise("nobody")
    s = s.select("c_nationkey", F.col("seg").alias("input_seg"), text.question(mention, F.lit("Name"), F.array(F.lit("<a [DESCRIPTION] b>"))).alias("question"), F.lit("<a [DESCRIPTION] b>").alias("output"))
    a = tables.aligned(s)
    return a.where(~F.contains("question", F.lit("[DESCRIPTION]"))).select("c_nationkey", F.md5("input_seg").alias("digest"), "output")


@query(f"SELECT c_nationkey, CAST(least(n, 7) - 1 AS INT) AS entity_row, 0 AS entity_col, c_name AS surface FROM ({_ROWS}) WHERE r = least(n, 7)")
def p24_adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with `input` in place of `input_seg` and columns by number; the entity's place is found."""
    s = segs(spark, sf_dir)
    mention = F.get("rows", F.least(F.size("rows"), F.lit(7)) - 1)["c_name"]
    s = s.select("c_nationkey", F.lit(None).cast("string").alias("input_seg"), F.col("seg").alias("input"), text.question(mention, F.lit("col 0"), F.array(F.lit("<a>"))).alias("question"))
    a = tables.adapted(s)
    return a.select("c_nationkey", F.col("entity.row").alias("entity_row"), F.col("entity.col").alias("entity_col"), F.col("entity.surface").alias("surface"))


@query("""WITH l AS (SELECT toxic, doc_id // 20 AS q, quality AS r, row_number() OVER (PARTITION BY toxic, doc_id // 20 ORDER BY doc_id) AS n FROM labels), h AS (SELECT *, sum(r) OVER (PARTITION BY toxic, q ORDER BY n) AS hits FROM l),
a AS (SELECT toxic, q, coalesce(sum(hits / n) FILTER (r = 1) / nullif(sum(r), 0), 0) AS ap FROM h GROUP BY 1, 2) SELECT toxic, round(avg(ap), 6) AS map FROM a GROUP BY 1""")
def a13_mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").groupBy("toxic", F.floor(F.col("doc_id") / 20).alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda s: s["quality"]).alias("rel"))
    return metrics.mean_average_precision(l, "rel", ["toxic"]).select("toxic", F.round("map", 6).alias("map"))


@query("""WITH l AS (SELECT doc_id // 20 AS q, quality AS r, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id // 20) AS size FROM labels) SELECT q, round(sum(r) FILTER (n <= 3) / 3, 6) AS p_at_3 FROM l WHERE size >= 3 GROUP BY 1""")
def a13_precision_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 20).alias("q")).agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda s: s["quality"]).alias("rel"))
    return l.where(F.size("rel") >= 3).select("q", F.round(metrics.precision_at(F.col("rel"), 3), 6).alias("p_at_3"))


@query("""WITH w AS (SELECT lang, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM documents), s AS (SELECT lang, list_distinct(w[:len(w) // 2]) AS g, list_distinct(w[len(w) // 2 + 1:]) AS p FROM w), f AS (SELECT lang, CASE WHEN len(p) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(p) END AS pr, CASE WHEN len(g) = 0 THEN 0 ELSE len(list_intersect(g, p)) / len(g) END AS re FROM s)
SELECT lang, round(avg(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END), 6) AS macro_f1 FROM f GROUP BY 1""")
def a14_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the words of the first and the second half of each text are, averaged per language."""
    d = table(spark, sf_dir, "documents").select("lang", F.filter(F.split(F.lower("text"), " "), lambda x: x != "").alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    d = d.select("lang", F.slice("w", 1, half).alias("g"), F.slice("w", half + 1, F.greatest(F.size("w"), F.lit(1))).alias("p"))
    return metrics.macro_f1(d, "g", "p", ["lang"]).select("lang", F.round("macro_f1", 6).alias("macro_f1"))


@query("SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 50) AS large FROM events")
def a15_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.counters(table(spark, sf_dir, "events"), errors=F.col("event_type") == "error", large=F.col("value") > 50)


@query(f"SELECT count(*) AS n, count(*) FILTER (c_nationkey % 2 = 1) AS not_inferred FROM (SELECT DISTINCT c_nationkey FROM ({_ROWS}))")
def a21_inference_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = segs(spark, sf_dir)
    mention = F.when(F.col("c_nationkey") % 2 == 0, F.get("rows", F.lit(0))["c_name"]).otherwise("nobody")
    return mining.counters(s.withColumn("at", tables.find_entity(F.col("seg"), mention, F.lit("Name"))), not_inferred=F.col("at").isNull())


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 1 OFFSET 17")
def s11_nth_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.nth(table(spark, sf_dir, "documents").select("doc_id", "source"), 17, "doc_id")


# Stub models: prompts are idx, gold and wrong answer, parted by tabs.
def _prompted(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = named(spark, sf_dir)
    q = text.question(F.col("name"), F.lit("Name"), F.array("gold", "wrong", "longer"))
    return n.select("idx", "gold", "wrong", F.concat_ws("\t", "idx", "gold", "wrong").alias("prompt"), q.alias("question"), F.concat_ws("|", "name", "seg").alias("key"))


def _stub(answer: Callable[[int, str, str], str]) -> Callable[[], Callable[[str], str]]:
    def make() -> Callable[[str], str]:
        def predict(prompt: str) -> str:
            idx, gold, wrong = prompt.split("\t")
            return answer(int(idx), gold, wrong)

        return predict

    return make


def _fail(*_: object) -> str:
    raise RuntimeError("no answer")


_ONCE = {"tries": 1, "pause": 0.0}
_TEACHER = {0: lambda i, g, w: f"<think>\nRow and column match.\nthe provided correct answer is it\n</think>\n{g}", 1: lambda i, g, w: w, 2: lambda i, g, w: g[1:-1], 3: _fail}


@query(f"""WITH {_NAMES}, a AS (SELECT *, replace(gold, '[DESC]', '[DESCRIPTION]') AS g, replace(wrong, '[DESC]', '[DESCRIPTION]') AS w FROM k)
SELECT idx, CASE idx % 4 WHEN 0 THEN '<think>' || chr(10) || 'Row and column match.' || chr(10) || '</think>' || chr(10) || g WHEN 1 THEN w WHEN 2 THEN g END AS output, CASE idx % 4 WHEN 0 THEN g WHEN 1 THEN w WHEN 2 THEN g[2:-2] ELSE '' END AS entity, idx % 4 IN (0, 2) AS is_correct, idx % 4 = 3 AS failed FROM a""")
def q13_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a teacher's reasoning, right and wrong ones told apart, failures kept with their error."""
    long = lambda c: F.replace(c, F.lit("[DESC]"), F.lit("[DESCRIPTION]"))
    s = _prompted(spark, sf_dir).select("idx", F.concat_ws("\t", "idx", long("gold"), long("wrong")).alias("prompt"), long("gold").alias("output"))
    got = mining.augment(s, _stub(lambda i, g, w: _TEACHER[i % 4](i, g, w)), **_ONCE)
    return got.select("idx", "output", F.col("model_pred_entity").alias("entity"), "is_correct", F.col("error").isNotNull().alias("failed"))


def _student(i: int, gold: str, wrong: str) -> str:
    return gold if i % 5 == 0 else f"<think>\nrow fits.\n</think>\n{wrong}</s>"


def _tutor(i: int, gold: str, wrong: str) -> str:
    if i % 5 == 1:
        return _fail()
    return wrong if i % 5 == 2 else f"<think>\nOne. Two.\nthe provided correct answer is it.\n</think>\n{gold}"


@query(f"""WITH {_NAMES} SELECT idx, '<think>' || chr(10) || CASE WHEN idx % 5 = 3 THEN 'Pool says.' ELSE 'One. Two.' END || chr(10) || '</think>' || chr(10) || gold AS accept, '<think>' || chr(10) || 'row fits.' || chr(10) || '</think>' || chr(10) || wrong AS reject, wrong AS model_prediction, CASE WHEN idx % 5 = 3 THEN 'pool' ELSE 'teacher' END AS source FROM k WHERE idx % 5 IN (3, 4)""")
def q14_mined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs of a student's wrong answers: accepts from the pool first, then from a teacher that is right."""
    s = _prompted(spark, sf_dir)
    good = F.concat(F.lit("<think>\nPool says.\n</think>\n"), "gold")
    pool = s.where(F.col("idx") % 5 == 3).select("key", F.posexplode(F.array("wrong", good, "gold")).alias("ord", "output"))
    got = mining.mine_pairs(s, _stub(_student), _stub(_tutor), pool, **_ONCE)
    return got.select("idx", "accept", "reject", "model_prediction", "source")


@query(f"WITH {_NAMES} SELECT idx, gold AS accept, '<think>' || chr(10) || 'row fits.' || chr(10) || '</think>' || chr(10) || wrong AS reject, wrong AS model_prediction FROM k WHERE idx % 5 > 0")
def q15_direct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mining.direct_pairs(_prompted(spark, sf_dir), _stub(_student), **_ONCE)
    return got.select("idx", "accept", "reject", "model_prediction")


def _again(i: int, gold: str, wrong: str) -> str:
    return _fail() if i % 8 == 2 else gold if i % 8 == 1 else f"<think>\nnow\n</think>\n{wrong}</s>"


@query(f"""WITH {_NAMES}, r AS (SELECT *, CASE idx % 4 WHEN 1 THEN '<think>' || chr(10) || 'unfinished' WHEN 2 THEN '' ELSE '<think>' || chr(10) || 'a' || chr(10) || '</think>' || chr(10) || wrong END AS reject FROM k)
SELECT idx, CASE WHEN idx % 8 IN (5, 6) THEN '<think>' || chr(10) || 'now' || chr(10) || '</think>' || chr(10) || wrong ELSE reject END AS reject, CASE WHEN idx % 8 IN (5, 6) THEN reject END AS before, CASE WHEN idx % 8 IN (5, 6) THEN wrong ELSE 'old' END AS model_prediction FROM r WHERE idx % 8 <> 1""")
def q17_regenerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects without an end asked for again; those that come out right are dropped."""
    whole = F.concat(F.lit("<think>\na\n</think>\n"), "wrong")
    rows = _prompted(spark, sf_dir).withColumn("reject", cases(F.col("idx"), 4, {1: "<think>\nunfinished", 2: ""}, whole)).withColumn("model_prediction", F.lit("old"))
    got = mining.regenerate(rows.select("idx", "prompt", "question", "gold", "reject", "model_prediction"), _stub(_again), 512, **_ONCE)
    return got.select("idx", "reject", F.col("reject_before_regen").alias("before"), "model_prediction")


@query("""WITH e AS (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS idx, event_type = 'click' AS main FROM events), m AS (SELECT DISTINCT idx FROM e WHERE main AND idx IS NOT NULL)
SELECT count(*) FILTER (main AND idx IS NULL) AS main_without_key, count(*) FILTER (main AND idx IS NOT NULL) AS main_rows, count(*) FILTER (NOT main AND idx IS NULL) AS shards_without_key, count(*) FILTER (NOT main AND idx IS NOT NULL) AS shards_rows,
  (SELECT count(*) FROM m) AS from_main, count(DISTINCT idx) FILTER (NOT main AND idx NOT IN (SELECT idx FROM m)) AS from_shards FROM e""")
def q18_merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a merge of a main file with its rank shards takes and passes over."""
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 > 0, F.col("user_id")).alias("idx"), F.col("event_id").alias("ord"), "event_type")
    return mining.merge_report(e.where(F.col("event_type") == "click"), e.where(F.col("event_type") != "click"))


@query("""WITH RECURSIVE o AS (SELECT s_suppkey AS idx, (s_suppkey * 37) % 101 + 5 AS size, row_number() OVER (ORDER BY (s_suppkey * 37) % 101 DESC, s_suppkey) AS r FROM supplier),
w AS (SELECT 0::BIGINT AS r, [0, 0, 0]::BIGINT[] AS load, 0::BIGINT AS rank UNION ALL SELECT o.r, list_transform(w.load, lambda v, i: v + CASE WHEN i = list_position(w.load, list_min(w.load)) THEN o.size ELSE 0 END), list_position(w.load, list_min(w.load)) - 1 FROM w JOIN o ON o.r = w.r + 1)
SELECT idx, rank, idx % 2 = 0 AS is_done FROM w JOIN o USING (r)""")
def q19_rebuilt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rank a balanced split gives each sample, and which of them are done already."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))
    got = mining.rebuilt_shards(s, s.where(F.col("idx") % 2 == 0), 3, (F.col("idx") * 37) % 101 + 5)
    return got.select("idx", F.col("rank").cast("long").alias("rank"), "is_done")


@query(f"""WITH {_THOUGHTS} SELECT CASE WHEN NOT has THEN 'accept_unparsable' WHEN doc_id % 5 = 4 THEN 'gold_mismatch' WHEN doc_id % 11 = 0 THEN 'reject_format_collapse' WHEN tag <> 'keep' THEN tag ELSE 'kept' END AS step, count(*) AS n FROM t GROUP BY 1""")
def q16_three_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structure, quality and length of pairs, with the step at which each goes; long accepts aren't cut here."""
    t = thoughts(spark, sf_dir).select(F.col("doc_id").alias("idx"), F.col("output").alias("accept"), F.when(F.col("doc_id") % 11 == 0, "a</s> b").otherwise("a</s>").alias("reject"), F.when(F.col("doc_id") % 5 == 4, "<Z [DESC] a [TYPE] b>").otherwise("<Y [DESCRIPTION] a [TYPE] b>").alias("gold"))
    return mining.funnel_three_steps(t, 1_000_000_000, 650).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_NAMES} SELECT idx % 7 AS part, count(*) AS n_total, count(*) FILTER (idx % 5 = 0) AS n_correct, count(*) FILTER (idx % 5 > 0) AS n_think, round(count(*) FILTER (idx % 5 = 0) / count(*), 6) AS accuracy FROM k GROUP BY 1""")
def x9_evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answers held against the gold ones, per part of the samples."""
    rows = mining.evaluate(_prompted(spark, sf_dir), _stub(_student), **_ONCE).withColumn("part", F.col("idx") % 7)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_total"), F.sum("correct").alias("n_correct"), F.count_if("has_think").alias("n_think"), F.round(F.avg("correct"), 6).alias("accuracy"))
