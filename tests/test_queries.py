"""Every query with a SQL twin gives its rows, whatever the partitioning; the others give rows."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave import catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(frame):
    cols = sorted(frame.columns)
    for c in cols:
        if str(frame[c].dtype).startswith("datetime"):
            frame[c] = frame[c].astype("datetime64[us]").astype(str)
    number = lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return cols, sorted(tuple(map(number, r)) for r in frame[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    mine = plain(catalog.queries()[name](spark, SMALL).toPandas())
    assert mine == plain(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("partitions", ["1", "17"])
def test_partitioning_does_not_matter(spark, duck, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("q4_candidates", "q3_one_job_per_table", "r6_shuffled_items", "w6_dense_ids", "j13_merge_last_wins"):
            assert plain(catalog.queries()[name](spark, SMALL).toPandas()) == plain(duck.execute(catalog.oracle_sql()[name]).df())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
