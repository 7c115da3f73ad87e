"""License scan: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Words are runs of a-z and 0-9 of the lower-cased text, shingles are five words. A text's shingles are cut into blocks of
UNIT; each two neighbouring blocks are a window. A template is cut into units of UNIT shingles, and wherever a unit
stands in a text some window holds it whole, so that window and unit have a Jaccard similarity of at least a half. A
band's MinHash is the shingle closest to the band's own corner of the hash space (its hash with the band's seed laid over
it is the smallest); the 16 corners are evenly spread, so the bands choose nearly without repetition, which misses less
than independent functions would. A test simulates it: of 100,000 unchanged units, half of a window's 16 shingles,
none was missed (independent bands: 0.5 ** 16), of those that lost one shingle about one in 9,000, of those that lost two
about one in 900. Of a template of which the share `contained` = 0.8 is left some unit has lost two shingles at most (one,
where its units don't overlap), and a template of several units is missed only if all its units are. A template of fewer than UNIT shingles has them singly as its units, and meets
windows of one shingle, with a similarity of one, in a single band.

The bands of all windows are looked up; what they don't retrieve isn't reported (a test takes bands away and loses
templates). The retrieved (text, template) pairs are few, texts are named in them by their 64-bit hash, and only
there the shingles are counted: a template is reported if at least `contained` of them are in the text.

Null text counts as empty. Repeated rows give repeated results (rows stand alone), an empty table gives an empty
result; other columns are ignored. Only SQL functions are used; the table of template units grows with the template
library alone and is sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.licenses import TEMPLATES
from cellweave.llm.scratch import cut

WIDTH = 5
UNIT = 8  # shingles of a block, and of a template's unit
BANDS = 16
_BROADCAST_PAIRS = 200_000  # retrieved (text, template) pairs sent to all tasks; more are joined by a shuffle


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(text: Column) -> Column:
    """Hash of the five words from each word on; a text with fewer words has none."""
    each = F.transform(_words(text), lambda w: F.xxhash64(w))
    runs = lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WIDTH)))), 1, F.greatest(F.size(h) - (WIDTH - 1), F.lit(0)))
    return _let(each, runs)


def _blocks(shingles: Column) -> Column:
    n = F.ceil(F.size(shingles) / UNIT).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda b: F.slice(shingles, b * UNIT + 1, UNIT))).otherwise(F.array().cast("array<array<bigint>>"))


def seeds(bands: int) -> list[int]:
    """The corners of the bands: the band's number with its bits reversed in the top six, other bits by a multiplier."""
    out = []
    for k in range(bands):
        seed = int(f"{k % 64:06b}"[::-1], 2) << 58 | ((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 6
        out.append(seed - (1 << 64) if seed >> 63 else seed)
    return out


def _minimum(block: Column, seed: Column) -> Column:
    """A band's MinHash of a block, under the band's seed."""
    return F.array_min(F.transform(block, lambda h: h.bitwiseXOR(seed)))


def _per_band(bands: int, body) -> Column:
    """An array of body(seed, band)."""
    return F.transform(F.array(*map(F.lit, seeds(bands))), body)


_ROW = "struct<band:int,least:bigint>"


def _bands(shingles: Column, bands: int) -> Column:
    """array<struct<band, least>> of all windows: two neighbouring blocks in the bands 0 to bands - 1, and each shingle
    by itself in the band -1. A last block stands alone as a window too."""

    def of_band(blocks: Column, seed: Column, band: Column) -> Column:
        # Numbers are told apart by hashing, structs would be by comparing all of them.
        windows = _let(F.transform(blocks, lambda block: _minimum(block, seed)), lambda least: F.array_distinct(F.transform(least, lambda x, i: F.least(x, F.get(least, i + 1)))))
        return F.transform(windows, lambda x: F.struct(band.alias("band"), x.alias("least")).cast(_ROW))

    wide = lambda blocks: F.flatten(_per_band(bands, lambda seed, band: of_band(blocks, seed, band)))
    single = F.transform(F.array_distinct(shingles), lambda h: F.struct(F.lit(-1).alias("band"), h.alias("least")).cast(_ROW))
    return F.concat(_let(_blocks(shingles), wide), single)


def _units(spark: SparkSession, templates: dict[str, str], bands: int) -> tuple[DataFrame, DataFrame]:
    """Rows (license, band, least) of the templates' units, and rows (license, size, of) of their shingles."""
    base = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    own = base.select("license", _shingles(F.col("body")).alias("s"), F.array_distinct(_shingles(F.col("body"))).alias("of")).where(F.size("of") > 0)
    # A template's last unit ends where the template does.
    starts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("s") / UNIT).cast("int") - 1), lambda b: F.least(b * UNIT, F.size("s") - UNIT))
    units = own.where(F.size("s") >= UNIT).select("license", F.explode(starts).alias("at"), "s").select("license", F.slice("s", F.col("at") + 1, UNIT).alias("unit"))
    wide = units.select("license", F.posexplode(_per_band(bands, lambda seed, band: _minimum(F.col("unit"), seed))).alias("band", "least"))
    single = own.where(F.size("s") < UNIT).select("license", F.lit(-1).alias("band"), F.explode("of").alias("least"))
    return wide.unionByName(single).distinct(), own.select("license", F.size("of").alias("size"), "of")


def retrieve(df: DataFrame, templates: dict[str, str] = TEMPLATES, bands: int = BANDS, text_col: str = "text") -> DataFrame:
    """The pairs (text_hash, license) that meet in a band."""
    units = cut(_units(df.sparkSession, templates, bands)[0], "units")
    docs = df.select(F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    docs = docs.select(F.xxhash64("__text").alias("text_hash"), _shingles(F.col("__text")).alias("__s"))
    # An inner explode would imply a filter, below which all the bands would be computed once more.
    seen = docs.select("text_hash", F.inline_outer(_let(F.col("__s"), lambda s: _bands(s, bands)))).where(F.col("band").isNotNull())
    return seen.join(F.broadcast(units), ["band", "least"]).select("text_hash", "license").distinct()


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, contained: float = 0.8, bands: int = BANDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license found: id_col, license, n_found (template shingles in the text), n_template,
    containment, first_word (where the first of them starts, from 0)."""
    found = cut(retrieve(df, templates, bands, text_col), "retrieved")
    own = cut(_units(df.sparkSession, templates, bands)[1], "templates")
    docs = df.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("text_hash", F.xxhash64("__text"))
    docs = docs.join(F.broadcast(found) if found.count() <= _BROADCAST_PAIRS else found, "text_hash")
    docs = docs.select("__id", "license", _shingles(F.col("__text")).alias("__s")).join(F.broadcast(own), "license")
    # The intersection keeps the text's order, so its first shingle is the first in the text.
    docs = docs.select("__id", "license", "size", "__s", F.array_intersect("__s", "of").alias("__in"), F.spark_partition_id().alias("__p"))
    n = F.size("__in")
    docs = docs.where((n > 0) & (n >= contained * F.col("size")))
    return docs.select(
        F.col("__id").alias(id_col), "license", n.cast("long").alias("n_found"), F.col("size").cast("long").alias("n_template"),
        (n / F.col("size")).alias("containment"), (F.array_position("__s", F.col("__in")[0]) - 1).cast("long").alias("first_word"),
    )


def oracle(templates: dict[str, str] = TEMPLATES, contained: float = 0.8) -> str:
    """The scan of documents in DuckDB: exact containment of every template in every text."""
    bodies = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(templates.items()))
    words = "list_filter(string_split_regex(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda x: x <> '')"
    runs = "list_transform(range(1, len(w) - {0} + 2), lambda i: array_to_string(w[i:i+{0}-1], ' '))".format(WIDTH)
    return f"""
WITH t AS (SELECT license, unnest(list_distinct({runs})) AS s FROM (SELECT license, {words.format("body")} AS w FROM (VALUES {bodies}) AS v(license, body))),
n AS (SELECT license, count(*) AS n_template FROM t GROUP BY license),
d AS (SELECT doc_id, unnest({runs}) AS s, unnest(range(len(w) - {WIDTH} + 1)) AS pos FROM (SELECT doc_id, {words.format("text")} AS w FROM documents) WHERE len(w) >= {WIDTH}),
h AS (SELECT doc_id, license, t.s, pos FROM d JOIN t ON d.s = t.s),
g AS (SELECT doc_id, license, count(DISTINCT s) AS n_found, min(pos) AS first_word FROM h GROUP BY doc_id, license)
SELECT g.doc_id, license, n_found, n_template, n_found / n_template AS containment, first_word
FROM g JOIN n USING (license) WHERE n_found >= {contained} * n_template
"""
