"""Queries without a SQL twin read whole texts."""

from __future__ import annotations

from test_functions import plain_compress

from cellweave import catalog

TAIL = "The row matches the column and the description fits the table context."


def test_compression_sees_the_end_of_a_long_text(spark, tmp_path):
    text = "".join(f"Nothing of note number {'x' * (i % 7 + 1)} {'y' * (i // 7 + 1)} stands here. " for i in range(60)) + TAIL
    spark.createDataFrame([(4, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()
    [got] = run("q12_compress")
    body = f"<think>\n {text}\n</think>\n<Y [DESC] a [TYPE] b>"
    assert TAIL in got["compressed"] and got["compressed"] == plain_compress(body, 40)
    assert got["before_tokens"] == int(len(body.split()) * 1.3)
    assert [r["avg_before"] for r in run("a8_compression_report")] == [got["before_tokens"]]
