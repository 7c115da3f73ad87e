"""Sources, merges, sampling, pairs and the streaming ingest on small cases."""

from __future__ import annotations

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators import knowledge, merging, pairs, predictors, retrieval, sampling, tables
from cellweave.sources import readers, writers
from cellweave.streaming import ingest

PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_json_lines_errors(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\nbad\n{"a": 2, "b": "}{"}\n')
    path = str(tmp_path / "x.jsonl")
    assert {r["a"] for r in readers.json_lines(spark, path, PAIR).collect()} == {1, 2}
    assert readers.json_lines(spark, path, PAIR, "keep").cache().where("__bad is not null").count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, path, PAIR, "fail").collect()


def test_json_array_of_odd_objects(spark, tmp_path):
    rows = [{"a": i, "b": 'q"\\{}[] é' * (i % 3)} for i in range(2500)]
    (tmp_path / "x.json").write_text(json.dumps(rows[:1000], indent=1) + "\n" + "[" + ",".join(map(json.dumps, rows[1000:])) + "]", encoding="utf-8")
    got = readers.read(spark, str(tmp_path / "x.json"), PAIR).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [(r["a"], r["b"]) for r in rows]
    assert list(readers.objects(['[{"a"', ': "}"}, {b', 'ad}]'])) == ['{"a": "}"}', "{bad}"]


def test_table_files(spark, tmp_path):
    good = {"text": [["H", "K"], ["x", None], "no list", ["Rome", "y"]], "link": [["", ""], ["X", ""], [], ["", ""]], "entity": [["", ""], ["", ""], ["Q9", ""], ["Q2", "Q3"]], "caption": "None", "external_context": {"z": "a {| x", "null": "<title> T </title>", "s": "x page"}}
    (tmp_path / "a.json").write_text(json.dumps(good))
    (tmp_path / "b.json").write_text("{broken")
    t = readers.tables(spark, str(tmp_path)).withColumn("text", tables.text_matrix(F.col("text"), F.col("cells"), F.col("header")))
    jobs = {r["job_id"]: r for r in tables.mention_jobs(t).collect()}
    # The row that is no list is gone, so the next one takes its number.
    assert set(jobs) == {"a.json#1:0", "a.json#2:0"} and jobs["a.json#2:0"]["gold_qid"] == "Q9" and jobs["a.json#1:0"]["gold_wiki_title"] == "X" and jobs["a.json#1:0"]["caption"] == ""
    r = t.select(tables.page_of(F.col("external_context")).alias("p"), tables.section_of(F.col("external_context"), F.lit("x"), F.lit("")).alias("s")).first()
    assert (r["p"], r["s"]) == ("T", "z")


def test_triples_and_upsert(spark):
    lines = ['<http://x/entity/Q1> <l> "A \\u00e9 \\"q\\""@en .', '<http://x/entity/Q1> <l> "B"@fr .', '<http://x/entity/Q1> <d/P31> <http://x/entity/Q5> .', '<http://x/entity/Q1> <d/P31> <http://x/entity/Q6> .', '<http://x/entity/Q1> <l> "late"@en', "noise"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "ord long, value string")
    e = knowledge.assemble(knowledge.parse_triples(df), "l", "desc", "alt", "d/").first()
    assert (e["qid"], e["label"], e["p31"], e["statement_count"]) == ("Q1", 'A é "q"', "Q5", 1)
    versions = spark.createDataFrame([("Q1", "old", 1), ("Q1", "new", 2)], "qid string, label string, ord long")
    assert knowledge.upsert(versions).first()["label"] == "new"


def test_merges(spark):
    main = spark.createDataFrame([(1, "m1", 1), (1, "m2", 2), (None, "x", 3)], "idx long, v string, ord long")
    shards = spark.createDataFrame([(1, "s", 1), (2, "a", 2), (2, "b", 3)], "idx long, v string, ord long")
    of = lambda df: {r["idx"]: r["v"] for r in df.collect()}
    assert of(merging.merge_main_wins(main, shards)) == {1: "m2", 2: "a"} and of(merging.merge_last_wins([main, shards])) == {1: "s", 2: "b"}
    delta = shards.withColumn("dropped", F.col("v") == "b")
    assert of(merging.apply_delta(main.where("idx is not null"), delta)) == {1: "s"}
    with pytest.raises(Exception, match="differ in length"):
        merging.zip_rows(main.select("ord", "v"), shards.where("ord > 1").select("ord", F.col("v").alias("w")), ["ord"]).collect()
    with pytest.raises(Exception, match="too few rows"):
        merging.take_exactly(main, 5).collect()
    gold = spark.createDataFrame([(["a"], "b"), (["a"], "a"), (["a"], "NIL"), ([], None)], "c array<string>, g string")
    assert [r["o"] for r in gold.select(merging.added_gold(F.col("c"), F.col("g")).alias("o")).collect()] == [["a", "b"], ["a"], ["a"], []]


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("ord"), (F.col("id") % 7).alias("t"), (F.col("id") * 37 % 101 + 1).alias("size"))
    assert sampling.split(df, "ord", 0.1).where("is_eval").count() == 100
    a, b = (sorted(r["ord"] for r in sampling.sample(df.repartition(n), "ord", 20).collect()) for n in (1, 9))
    assert a == b and len(a) == 20
    placed = sampling.balanced(df, F.col("size"), 4)
    loads = Counter()
    for r in placed.collect():
        loads[r["worker"]] += r["size"]
    assert placed.count() == 1000 and max(loads.values()) - min(loads.values()) <= 101
    assert {r["t"] for r in sampling.first_tables(df, "t", 3).collect()} == {0, 1, 2} and sampling.first_tables(df, "t", 3).count() == 3 and sampling.first_tables(df, "t", 9).count() == 1000


def test_prefix_and_top(spark):
    aliases = spark.createDataFrame([("cold ring", "Q1", 1), ("cold nut", "Q2", 2), ("co", "Q3", 3), ("warm", "Q4", 4)], "alias_norm string, qid string, ord long")
    mentions = spark.createDataFrame([("cold",), ("co",), ("c",), ("cold",)], "mention_norm string")
    got = {(r["mention_norm"], r["qid"]) for r in retrieval.prefix(mentions, aliases, limit=2).collect()}
    assert got == {("cold", "Q1"), ("cold", "Q2"), ("co", "Q1"), ("co", "Q2"), ("c", "Q1"), ("c", "Q2")}


def test_pairs(spark):
    df = spark.createDataFrame([("p", "<a [DESC] x [TYPE] y>", "noise <b"), ("p", "no", "<b"), ("p", " <c", "none")], "prompt string, accept string, reject string")
    assert [tuple(r) for r in pairs.align(df).collect()] == [("p<", "a [DESC] x [TYPE] y>", "b")]
    pool = spark.createDataFrame([("k", "<think>n</think><b>", 1), ("k", "<think>y</think><a>", 2), ("k", "<a>", 3)], "key string, output string, ord long")
    jobs = spark.createDataFrame([("k", "<a>"), ("k", "<z>")], "key string, gold string")
    assert {r["gold"]: r["accept"] for r in pairs.reference_output(jobs, pool).collect()} == {"<a>": "<think>y</think><a>", "<z>": None}


def test_predictor_errors_stay_in_their_row(spark):
    def make():
        def predictor(prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return prompt.upper()

        return predictor

    df = spark.createDataFrame([("a",), ("bad",), (None,)], "prompt string")
    got = {r["prompt"]: (r["raw_prediction"], r["error"] is None) for r in predictors.predict(df, make, pause=0.01).collect()}
    assert got == {"a": ("A", True), "bad": (None, False), None: ("", True)}


def test_streaming_resume(spark, tmp_path):
    schema = T.StructType([T.StructField("job_id", T.StringType()), T.StructField("n", T.LongType())])
    inbox, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    run = lambda: ingest.run_new_jobs(spark, inbox, schema, lambda df: df.withColumn("done", F.lit(True)), out, state)
    (tmp_path / "in" / "1.json").write_text('{"job_id":"a","n":1}\n{"job_id":"a","n":1}\n{"job_id":"b","n":2}\n')
    run()
    (tmp_path / "in" / "2.json").write_text('{"job_id":"b","n":2}\n{"job_id":"c","n":3}\n')
    run()
    assert sorted(r["job_id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, "x")], "a long, b string")
    writers.json_array(df, str(tmp_path / "o.json"), "a")
    assert json.loads((tmp_path / "o.json").read_text(encoding="utf-8")) == [{"a": 1, "b": "x"}, {"a": 2, "b": "é"}]
    writers.data_and_audit(df, ["a"], ["b"], str(tmp_path / "dual"))
    assert spark.read.json(str(tmp_path / "dual/audit")).count() == 2
    pairs.by_correctness(df.withColumn("correct", F.col("a") - 1), str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split/is_correct=true")).first()["b"] == "é"


def test_sample_filters(spark):
    df = spark.createDataFrame([(1, None, "<think>a</think><b>", 0, "x"), (2, "", "<think>a</think>", 1, "</think>"), (3, "<think> </think>", None, 1, None)], "ord long, o string, p string, correct int, raw_prediction string")
    got = df.select(pairs.has_reasoning(F.col("o"), F.col("p")).alias("h"), pairs.first_text(F.col("o"), F.col("p")).alias("t")).collect()
    assert [r["h"] for r in got] == [True, False, False] and got[1]["t"] == ""
    assert [tuple(r) for r in pairs.wrong_lines(df).orderBy("ord").collect()] == [(1, True, True), (3, False, True)]
    lengths = spark.createDataFrame([(5, 1), (9, 3), (10, 1), (2, 7)], "p int, o int")
    steps = pairs.training_lengths(F.col("p"), F.col("o"), 10, 6)
    assert [r["drop_reason"] for r in pairs.funnel(lengths, steps).collect()] == [None, "too_long", "all_masked", "output_too_long"]
