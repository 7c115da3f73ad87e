"""Rows that the pipeline's stages keep on tables with missing labels, repeated ids or none."""

from __future__ import annotations

import zlib

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
HELD_OUT = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOCS)


@pytest.mark.parametrize("lang", [None, "en"], ids=["no labels", "labels on held-out rows"])
def test_language_stage_without_a_model(spark, lang):
    texts = ["clean text", "éa", "12 34 !", "", None, "日本語", "²½"]
    docs = frame(spark, [(i, t, lang) for i, t in zip(HELD_OUT, texts, strict=False)])
    got = corpus_pipeline.identify_language(spark, docs, "")
    assert sorted(r["text"] for r in got.collect()) == sorted(["clean text", "éa", "日本語"]) and got.columns == docs.columns


@pytest.mark.parametrize("stage", ["drop_copies", "drop_near_copies"])
def test_dedup_stages_with_null_and_repeated_ids(spark, stage):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    # Copies under null ids, a copy with the same id, a copy whose other row's id names a clean text too.
    rows = [(None, a, "en"), (None, a, "en"), (3, b, "en"), (3, b, "en"), (5, c, "en"), (8, c, "en"), (5, d, "en"), (8, e, "en"), (None, "", "en")]
    got = getattr(corpus_pipeline, stage)(spark, frame(spark, rows), "")
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    kept = 8 if stage == "drop_copies" else 5
    assert sorted((r["text"], r["doc_id"] or 0) for r in got.collect()) == sorted([(a, 0), (b, 3), (c, kept), (d, 5), (e, 8), ("", 0)])


CLASHES = "lang_pred string, score double, digest string, fp string, n long, sig string, keep_id long, spans string, part string, text_hash string, id string, batch string"


@pytest.mark.parametrize("stage", ["identify_language", "drop_copies", "drop_near_copies", "redact_pii"])
def test_stages_with_clashing_columns_and_empty_tables(spark, stage):
    texts = [" ".join(f"{x}{i}" for i in range(30)) + " a@b.org" for x in ("red", "blue", "old")]
    rows = [(i, t, "en", "s", len(t), "x", 0.5, "d", "f", 3, "s", 9, "p", "q", "h", "i", "b") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, f"{DOCS}, {CLASHES}")
    run = getattr(corpus_pipeline, stage)
    got = run(spark, docs, "")
    assert got.columns == docs.columns
    plain = sorted(tuple(r) for r in got.collect())
    if stage == "redact_pii":
        assert [r[1] for r in plain] == [t.replace("a@b.org", "<EMAIL>") for t in texts] and [r[4] for r in plain] == [len(t) for t in texts] and [r[5:] for r in plain] == [r[5:] for r in rows]
    else:
        assert plain == rows
    none = run(spark, docs.limit(0), "")
    assert none.count() == 0 and none.columns == docs.columns


def test_redaction_without_a_length_column(spark):
    docs = spark.createDataFrame([(1, "a@b.org"), (2, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in corpus_pipeline.redact_pii(spark, docs, "").collect()) == [(1, "<EMAIL>"), (2, None)]


def test_packing_clashing_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b", 1, 2), (5, "a b", 1, 2), (5, "a b", 1, 2), (6, None, 1, 2)], "doc_id long, text string, piece long, part long")
    got = corpus_pipeline.pack_sequences(spark, docs, "")
    assert got.schema["piece"].dataType.simpleString() == "int"
    rows = got.collect()
    assert sorted(r["doc_id"] or 0 for r in rows) == [0, 5, 5, 6] and len({r["sequence_id"] for r in rows}) == 1
    at = 0
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert r["offset"] == at
        at += r["length"]
