"""Passages of few words are found as their SQL finds them."""

from __future__ import annotations

import duckdb
import pytest

from cellweave import catalog
from cellweave.plans import corpora


@pytest.mark.parametrize("most", [10_000, 1], ids=["broadcast", "product"])
def test_short_passages(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(corpora, "_BROADCAST_PASSAGES", most, raising=False)
    passages = ["one", "one two", "a b c d e", "a b c d e f", "a b c d e f g", "a b c d e f g h", "a  b", "", "not there", None]
    texts = ["one two three", "xa b c d e f.", "a b c d e fx", "za b c d e f g.", "a b c d e f g hi", "a  b c", "", None]
    for name, rows, schema in (("benchmark", passages, "item_id long, text string"), ("documents", texts, "doc_id long, text string")):
        spark.createDataFrame(list(enumerate(rows)), schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = catalog.queries()["p20_passages"](spark, str(tmp_path)).select("item_id", "doc_id").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.oracle_sql()["p20_passages"]).fetchall())
