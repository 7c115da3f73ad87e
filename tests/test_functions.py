"""Functions against plain Python on small cases."""

from __future__ import annotations

import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from cellweave.functions import reasoning as R
from cellweave.functions import scoring, text
from cellweave.operators import metrics, quality, tables

ENTITY = "<Paris [DESCRIPTION] capital of France [TYPE] city>"


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def plain_normalize(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not unicodedata.combining(c)).lower()
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9\s]", " ", re.sub(r"\([^)]*\)", " ", s))).strip()


def test_clean_and_normalize(spark):
    texts = ["  a  b\t\n c ", None, "", "é 　x\x1c", "Café (band) №5", "ﬁ①", "İstanbul", "A-b_C"]
    assert values(spark, texts, text.clean_text) == [re.sub(r"\s+", " ", t or "").strip() for t in texts]
    assert values(spark, texts, text.normalize_text) == [plain_normalize(t) for t in texts]


def test_question_round_trip(spark):
    q = "The selected entity mention in the table cell is: Paris. The column name for 'Paris' is City. The referent entity candidates are: <a [DESCRIPTION] b [TYPE] c>, <d [DESCRIPTION] None [TYPE] e> What is the correct referent entity for the entity mention 'Paris'?"
    assert values(spark, [q], text.question_mention) == ["Paris"] and values(spark, [q], text.question_column) == ["City"]
    assert values(spark, [q], text.question_candidates) == [["<a [DESCRIPTION] b [TYPE] c>", "<d [DESCRIPTION] None [TYPE] e>"]]
    assert values(spark, [q], lambda x: text.strict_candidates(x, F.lit(2)).isNotNull()) == [True] and values(spark, [q], lambda x: text.strict_candidates(x, F.lit(3))) == [None]


def test_wait_seconds(spark):
    assert values(spark, ["try again in 250 ms", "Please try again in 3 m.", "try again in 1.5s", "nothing"], text.wait_seconds) == [0.25, 180.0, 1.5, 600.0]


def test_parse_and_think(spark):
    outs = [f"<think>\nso it is\n</think>\n{ENTITY}", f"no tags {ENTITY}", "<think>a</think> none", f"a</think>b</THINK> {ENTITY}", None, f"<think></think>{ENTITY}"]
    got = values(spark, outs, R.parse_output)
    assert [g and tuple(g) for g in got] == [("so it is", ENTITY), None, None, ("a</think>b", ENTITY), None, ("", ENTITY)]
    assert values(spark, outs, R.think_of) == ["so it is", None, "a", None, None, ""]


def test_sentences_and_repeats(spark):
    texts = ["One. Two! Three?\nFour\n\nfive. ", "不错。 好", "", None, "a.b c"]
    plain = lambda t: [p.strip() for p in re.split(r"(?<=[.!?。！？])\s+|\n+", t or "") if p and p.strip()]
    assert values(spark, texts, R.sentences) == [plain(t) for t in texts]
    assert values(spark, ["a b a b a b", "a b", "a b c d"], lambda x: R.repeat_ratio(x, 2)) == [pytest.approx(0.6), 0.0, 0.0]
    assert values(spark, [["A b", "a  B", " ", "c", "C", "d"]], R.distinct_sentences, "array<string>") == [["A b", "c", "d"]]


@pytest.mark.parametrize(("raw", "form"), [
    (ENTITY, "<Paris [DESC] capital of France [TYPE] city>"), (f"<think>x</think> <a> {ENTITY}</s>", "<Paris [DESC] capital of France [TYPE] city>"), ("'Paris'", "<Paris>"),
    ("<\"Paris\" [ desc ] a [type] b> tail", "<Paris [DESC] a [TYPE] b>"), ("see <Paris [DESC] x", "<Paris [DESC] x>"), ("", ""), (None, ""), ("<>", ""), ("plain", "<plain>"),
])
def test_answer_form(spark, raw, form):
    assert values(spark, [raw], R.answer_form) == [form]


def test_scores(spark):
    df = spark.createDataFrame([("cold ring", "cold ring"), ("cold ring", "cold nut"), ("", "x"), ("ab", "abc")], "a string, b string")
    got = [r["s"] for r in df.select(scoring.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == pytest.approx([1.0, 0.75 / 3 + 0.25 * 5 / 9, 0.0, 0.25 * 2 / 3])
    assert values(spark, ["human", "big city", "stone"], lambda x: scoring.type_match(F.lit("player name"), x)) == [1.0, 0.0, 0.0]
    one = df.limit(1).select(scoring.bm25_term(F.lit(2.0), F.lit(3.0), F.lit(10.0), F.lit(8.0), F.lit(100.0)).alias("s")).first()["s"]
    assert one == pytest.approx(math.log(97.5 / 3.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 10 / 8)))
    assert df.limit(1).select(scoring.name_cosine(F.lit("abcd"), F.lit("abcd")).alias("s")).first()["s"] == pytest.approx(1.0)


def test_metrics(spark):
    assert values(spark, [[1, 1, 0, 1, 0, 1, 0, 0, 0, 1], [0], []], metrics.average_precision, "array<int>") == pytest.approx([0.7833333333333333, 0.0, 0.0])
    assert values(spark, [[0, 0, 1]], lambda x: metrics.precision_at(x, 3), "array<int>") == pytest.approx([1 / 3])
    with pytest.raises(Exception, match="shorter than k"):
        values(spark, [[1]], lambda x: metrics.precision_at(x, 2), "array<int>")
    r = metrics.paired_changes(spark.createDataFrame([(0, 1)] * 9 + [(1, 0)] * 2 + [(1, 1)], "b int, a int"), "b", "a").first()
    assert (r["fixed"], r["broken"], r["n"]) == (9, 2, 12) and r["p_value"] == pytest.approx(2 * (1 + 11 + 55) / 2**11)


SEG = "[TLE] The Wikipedia page is about P. The Wikipedia section is about S. [TAB] col: | City | Note | " + " [SEP] ".join(f"row {i}: | c{i} | n{i} |" for i in range(1, 13))


def test_table_text(spark):
    assert values(spark, [SEG], tables.seg_header) == [["City", "Note"]]
    rows = values(spark, [SEG], tables.seg_rows)[0]
    assert len(rows) == 12 and rows[11]["number"] == 12 and rows[11]["cells"] == ["c12", "n12"]
    at = lambda m: lambda x: tables.find_entity(x, F.lit(m), F.lit("city"))
    assert tuple(values(spark, [SEG], at("C12"))[0]) == (11, 0) and values(spark, [SEG], at("zzz")) == [None]
    short = values(spark, [SEG], lambda x: tables.simplify(x, at("c12")(x)))[0]
    assert "row 3: c3 [SEP]" in short and "row 12: | c12 | n12 |" in short and "c2 " not in short
    assert values(spark, [SEG], text.page_key) == ["P\x1fS"]


def plain_compress(out, target):
    count = lambda t: max(1, int(len(t.split()) * 1.3)) if t.split() else 0
    m = re.search(r"<think>(.*)</think>(.*)$", out, re.S)
    body, entity = m[1].strip(), m[2].strip()
    budget = max(16, target - count(f"<think>\n\n</think>\n{entity}") - 8)
    pool = [s for s in dict.fromkeys(p.strip() for p in re.split(r"(?<=[.!?])\s+|\n+", body) if p.strip()) if "[TYPE]" not in s]
    evidence = lambda s: sum(bool(re.search(p, s, re.I)) for p in R.SENTENCE_EVIDENCE)
    chosen = []
    for i in sorted(range(len(pool)), key=lambda i: (-evidence(pool[i]), i)):
        if not chosen or count(" ".join(pool[j] for j in [*chosen, i])) <= budget:
            chosen.append(i)
        if count(" ".join(pool[j] for j in chosen)) >= budget:
            break
    return f"<think>\n{' '.join(pool[i] for i in sorted(chosen))}\n</think>\n{entity}"


def test_compress(spark):
    body = "We see a list of things here today. The column says City and the row matches. Other words fill this sentence up now. The page context fits. One more idle line with many words in it. <a [DESC] b [TYPE] c> is a candidate."
    out = f"<think>\n{body}\n</think>\n{ENTITY}"
    df = spark.createDataFrame([(out,), ("broken",)], "output string")
    got = [tuple(r) for r in quality.compress(df, "output", 50).select("compressed", "reason").collect()]
    assert got == [(plain_compress(out, 50), "ok"), ("broken", "unparsable")]


def test_low_info_rules(spark):
    good = "The column header says City and the page context matches Paris, unlike the other candidate which is a film, so it refers to the capital."
    rows = [f"<think>{good}</think>{ENTITY}", ENTITY, f"<think></think>{ENTITY}", f"<think>Sorry</think>{ENTITY}", f"<think>{good} The final answer is <X [DESC] a [TYPE] b></think>{ENTITY}"]
    got = [(r["tag"], r["score"]) for r in quality.low_info(spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, output string"), "output").orderBy("i").collect()]
    assert [t for t, _ in got] == ["keep", "hard_drop", "hard_drop", "hard_drop", "keep"] and got[4][1] == got[0][1] + 4
