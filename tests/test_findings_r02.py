"""What the findings of round 2 were about: whole groups that met pair by pair, and values worked out again and again."""

from __future__ import annotations

import math
import random
import time
from collections import Counter

from pyspark.sql import functions as F

from cellweave.functions import reasoning, scoring
from cellweave.operators import pairs, retrieval
from cellweave.plans import linking as linking_plans


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_reference_outputs_meet_by_their_answer(spark):
    jobs = spark.createDataFrame([(1, "k", "<a [DESC] b [TYPE] c>"), (2, "k", "<z>"), (3, "l", "<'a' [ desc ] b [type] c>"), (4, "k", None), (5, None, "<a>"), (6, "k", "")], "id long, key string, gold string")
    pool = spark.createDataFrame([("k", "x</think><a [DESCRIPTION] b [TYPE] c></s>", 5), ("k", "<'a' [desc] b [ type ] c>", 3), ("l", "z", 1), ("k", None, 9), (None, "<a>", 1), ("k", "< >", 8)], "key string, output string, ord long")
    got = pairs.reference_output(jobs, pool)
    assert {r["id"]: r["accept"] for r in got.collect()} == {1: "<'a' [desc] b [ type ] c>", 2: None, 3: None, 4: None, 5: None, 6: "< >"}
    # A condition on answers inside the join compares each job with all of its key's pool.
    joins = [line for line in plan_of(got).splitlines() if "Join" in line]
    assert joins and not any("regexp" in line for line in joins)


def test_answer_form_collapses_any_white_space(spark):
    rows = [(f"<{a}n{b}  m{a}[ desc\t]{b}d{a}[type]t>{b}",) for a in ("", " ", " ", "\n  ") for b in ("", "\x1c", " \u0085", "  ")]
    got = spark.createDataFrame(rows, "x string").select("x", reasoning.answer_form(F.col("x")).alias("form")).collect()
    gap = lambda c: " " if c else ""
    for (x,), r in zip(rows, got, strict=True):
        a, b = x[1:x.index("n")], x[x.index(">") + 1:]
        assert r["form"] == f"<n{gap(b)} m [DESC]{gap(b)}d{gap(a)}[TYPE]t>".replace("  ", " "), repr(x)


def most_rows(spark, frame) -> int:
    """Collects the frame without adaptive execution; the most rows that an operator of its plan gave."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame.collect()
        todo, most = [frame._jdf.queryExecution().executedPlan()], 0
        while todo:
            node = todo.pop()
            n = node.metrics().get("numOutputRows")
            most = max(most, n.get().value() if n.isDefined() else 0)
            todo += [node.children().apply(i) for i in range(node.children().size())]
        return most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_common_terms_meet_few_texts(spark):
    docs = spark.range(2000).selectExpr("concat('Q', id) AS qid", "concat('w', id % 40, ' common x', id % 7) AS body")
    mentions = spark.range(300).selectExpr("concat('w', id % 40, ' common z', id) AS mention_norm")
    found = retrieval.full_text(mentions, docs, limit=3)
    assert most_rows(spark, found) < 20_000  # each mention shares a term with all 2,000
    assert found.count() == 900


def test_best_texts_as_all_pairs_give_them(spark):
    rnd = random.Random(3)
    vocabulary = ["a"] * 9 + ["b"] * 5 + ["c", "d", "e", "f", "g"]
    bodies = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 4))) for _ in range(400)]
    asked = sorted({" ".join(rnd.choices([*vocabulary, "z"], k=rnd.randint(1, 4))) for _ in range(60)})
    words = [b.split() for b in bodies]
    average, df = sum(map(len, words)) / 400, {t: sum(t in w for w in words) for t in "abcdefg"}
    part = lambda t, w: max(math.log((400 - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / average))
    want = set()
    for m in asked:
        hits = [(-round(sum(part(t, w) for t in m.split() if t in w), 9), f"Q{i}") for i, w in enumerate(words) if set(m.split()) & set(w)]
        want |= {(m, q, i + 1) for i, (_, q) in enumerate(sorted(hits)[:5])}
    found = retrieval.full_text(spark.createDataFrame([(m,) for m in asked], "mention_norm string"), spark.createDataFrame([(f"Q{i}", b) for i, b in enumerate(bodies)], "qid string, body string"), limit=5)
    assert {(r["mention_norm"], r["qid"], r["rank"]) for r in found.collect()} == want


def test_mentions_are_normalised_once_per_part(spark):
    lines = plan_of(linking_plans.jobs(spark, "/root/testdata/sf0.001")).splitlines()
    join = next(i for i, line in enumerate(lines) if "Join" in line)
    assert not any("regexp" in line for line in lines[:join]) and any("regexp" in line for line in lines[join:])


def test_gram_cosine_of_long_names(spark):
    rnd = random.Random(4)
    texts = ["", "a", "aaaaaa", "abcabcabc", *("".join(rnd.choices("ab é", k=rnd.randint(1, 40))) for _ in range(60)), *("".join(chr(97 + rnd.randrange(26)) for _ in range(4000)) for _ in range(2))]
    rows = spark.createDataFrame([(a, b) for a, b in zip(texts, texts[1:], strict=False)], "a string, b string")
    grams = lambda x: Counter(g for n in (3, 4) for g in ([x[i:i + n] for i in range(len(x) - n + 1)] or [x]) if x)
    norm = lambda c: math.sqrt(sum(v * v for v in c.values()))
    began = time.time()
    got = rows.select("a", "b", scoring.name_cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert time.time() - began < 20  # every gram against every other takes minutes
    for a, b, c in got:
        x, y = grams(a), grams(b)
        assert c == (sum(v * y[g] for g, v in x.items()) / (norm(x) * norm(y)) if x and y else 0.0)
