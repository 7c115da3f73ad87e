"""Jaccard join of documents on word shingles, by vertical partitioning.

The global order of all shingles (by hash) is cut into fragments, and a document's set into the segments that fall in
them. Work never leaves a fragment:

* Candidates. A set of n shingles differs from any set that it links with, at a similarity of t, in at most
  k = n(1-t)/t shingles. Sets are filed by size level (levels a factor of four apart; a set close to the next level is
  filed there too) and cut into that level's fragments, of which there are more than k. A linked pair holds the same segment
  in all fragments but k, so it shares one of the first k + 1 segments of either set in any order that depends on the
  segments alone. That order is by size: a set is filed under its k + 1 largest segments, which hardly ever agree by chance
  or by a passage that many documents share. If all equal segments of a pair are empty, both sets have at most k
  segments; such sets are filed by their first k + 1 shingles as well. No pair is lost.
* Overlaps. Candidate pairs meet fragment by fragment, count the partial overlap there, and the counts are summed per
  pair. Fragments whose digests agree hold the same shingles, and only the others' segments move.

What keeps this linear for large groups: documents with equal sets are one class from the start; a bucket first pairs
its members with one pivot only; after the components of these links are known, only buckets that still hold several
components pair the members of different ones. A parity sketch of each set, of about as many bits as it has shingles, bounds the
difference of a pair from below and drops most pairs that can't link before their sets are read. Pairs inside a
component are never listed, and no link between components is lost.

Shingles are told apart by 64-bit keyed hashes (see shingles). Rows with a null id have no identity: they link with nothing and have a null component_id. Null and wordless texts
have an empty set and are their own component. Repeated rows are one class. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import shingles
from cellweave.llm.components import components
from cellweave.llm.scratch import cut, drop_table, small_batches, sweep

_SKETCH = 8  # longs of a short parity sketch
_STEP = 4  # a level's largest size by its smallest
_FRAGMENTS = 32  # fragments in which overlaps are counted
_CUTS = np.array([(j << 64) // _FRAGMENTS for j in range(1, _FRAGMENTS)], np.uint64)
_BROADCAST_ROWS = 200_000  # candidate ids, or pairs, sent to all tasks; more are joined by a shuffle
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)


def _levels() -> np.ndarray:
    """Smallest size of each level."""
    return np.array([_STEP**i for i in range(21)], np.int64)


def signatures(own: np.ndarray, percent: int, levels: np.ndarray) -> np.ndarray:
    """The buckets of a sorted set."""
    n = len(own)
    at = int(np.searchsorted(levels, n, side="right")) - 1
    out = []
    most = (100 - percent) * n // percent  # differences from any set it may link with
    mixed = shingles.mix(own)
    for level in (at, at + 1) if 100 * n >= percent * levels[at + 1] else (at,):
        # A third more fragments than the level's largest set may have differences.
        fragments = (int(levels[level + 1]) - 1) * (100 - percent) * 4 // (3 * percent) + 2
        fragment = ((own >> _U(32)) * _U(fragments)) >> _U(32)
        starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
        tag = shingles.mix((fragment[starts] + _U(level << 40)) * _GOLD)
        sigs = shingles.mix(np.add.reduceat(mixed, starts) ^ tag)
        if len(starts) <= most:
            out.append(shingles.mix(own[: most + 1] ^ shingles.mix(np.array([level + (1 << 20)], _U) * _GOLD)))
        else:
            sizes = np.diff(np.append(starts, n))
            sigs = sigs[np.lexsort((sigs, -sizes))[: most + 1]]
        out.append(sigs)
    return np.unique(np.concatenate(out))


def sketch(own: np.ndarray, longs: int = _SKETCH) -> np.ndarray:
    """Parity bits: two sketches differ in at most as many bits as their sets in elements."""
    h = shingles.mix(own ^ _GOLD)
    bits = np.bincount((h % _U(64 * longs)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def wide_sketch(own: np.ndarray) -> np.ndarray | None:
    """A sketch of the next power of two of bits above the set's size; none if the short one has as many."""
    longs = 1 << max(0, (len(own) - 1).bit_length() - 6)
    return sketch(own, longs) if longs > _SKETCH else None


def digests(own: np.ndarray) -> np.ndarray:
    """A hash of each fragment's segment of a sorted set, 0 for an empty one."""
    ends = np.concatenate([[0], np.searchsorted(own, _CUTS), [len(own)]])
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(shingles.mix(own + _GOLD))])
    return (sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)


def _bytes(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _short(fp: bytes) -> int:
    return int.from_bytes(fp[:8], "big", signed=True)


def _sets(df: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Per row: id, n, fp and short (of the set); and its sketches, parts and sigs, which only the first row of a set in a task
    has: a text that many rows share is filed once per task."""
    schema = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("short", T.LongType())])
    for c in ("sketch", "wide", "parts", "sigs"):
        schema = schema.add(c, T.ArrayType(T.LongType()))
    levels = _levels()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for whole in batches:
            for at in range(0, len(whole), 512):  # small batches out: sets are larger than their texts
                batch = whole.slice(at, 512)
                n, fp, filed = [], [], ([], [], [], [])
                for own in shingles.sets(_bytes(batch, "text"), width):
                    n.append(len(own))
                    name = shingles.fingerprint(own) if len(own) else None
                    fp.append(name)
                    new = name is not None and name not in known
                    for column, value in zip(filed, (sketch(own), wide_sketch(own), digests(own), signatures(own, percent, levels).view(np.int64)) if new else (None,) * 4, strict=True):
                        column.append(value)
                    known.add(name)
                short = [f and _short(f) for f in fp]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(short, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in filed)], names=schema.names)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _shared(filed: DataFrame) -> DataFrame:
    """The rows (sig, short) of buckets with several sets. Rows are ordered over all partitions, so a bucket of any size
    is spread over as many as it fills, and a row is dropped only if its neighbours in the partition are of other buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, left = True, None  # the bucket at hand, of which only one row has been seen
        for batch in batches:
            sig, short = (batch.column(i).to_numpy() for i in range(2))
            if left is not None:
                sig, short = np.append(left[0], sig), np.append(left[1], short)
            if not len(sig):
                continue
            new = np.append(True, (sig[1:] != sig[:-1]) | (short[1:] != short[:-1]))
            sig, short = sig[new], short[new]
            same = sig[1:] == sig[:-1]
            keep = np.append(same, False) | np.append(False, same)
            keep[0] |= first  # its bucket may have begun in the partition before
            # The last row waits for what follows; it is sent now too if it already has company.
            left = (sig[-1:], short[-1:])
            keep[-1] &= len(sig) > 1 and bool(same[-1])
            first = first and len(sig) == 1
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(short[keep])], names=["sig", "short"])
        if left is not None:
            yield pa.RecordBatch.from_arrays([pa.array(left[0]), pa.array(left[1])], names=["sig", "short"])

    n = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = filed.repartitionByRange(n, "sig", "short").sortWithinPartitions("sig", "short")
    return ordered.mapInArrow(run, "sig long, short long")


def _segments(df: DataFrame, width: int) -> DataFrame:
    """Per row of (c, fp, text): its set as (c, fragment, segment) rows, one per fragment that isn't empty. A text whose
    set isn't that of fp (a row that shares its id with the set's own) gives none."""
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("fragment", T.IntegerType()), T.StructField("segment", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                take, fragment, segment = [], [], []
                for i, (own, fp) in enumerate(zip(shingles.sets(_bytes(batch, "text"), width), batch.column("fp").to_pylist(), strict=True)):
                    if not len(own) or shingles.fingerprint(own) != fp:
                        continue
                    for j, part in enumerate(np.split(own, np.searchsorted(own, _CUTS))):
                        if len(part):
                            take.append(i)
                            fragment.append(j)
                            segment.append(part.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("c").take(pa.array(take, pa.int64())), pa.array(fragment, pa.int32()), pa.array(segment, pa.list_(pa.int64()))], names=schema.names)

    return df.select("c", "fp", "text").mapInArrow(run, schema)


def _differ() -> Column:
    """Bits in which the short sketches s_a and s_b differ."""
    bits = [F.bit_count(F.col("s_a")[i].bitwiseXOR(F.col("s_b")[i])) for i in range(_SKETCH)]
    return sum(bits[1:], bits[0])


def _wide_differ() -> Column:
    """Bits in which the wide sketches w_a and w_b differ; of one twice as long the halves are laid over each other. 0 if
    either is missing."""
    half = lambda w: (F.size(w) / 2).cast("int")
    fold = lambda w: F.zip_with(F.slice(w, 1, half(w)), F.slice(w, half(w) + 1, half(w)), lambda x, y: x.bitwiseXOR(y))
    fit = lambda w, other: F.when(F.size(w) > F.size(other), fold(F.col(w))).otherwise(F.col(w))
    bits = F.zip_with(fit("w_a", "w_b"), fit("w_b", "w_a"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.when(F.col("w_a").isNotNull() & F.col("w_b").isNotNull(), F.aggregate(bits, F.lit(0), lambda acc, x: acc + x)).otherwise(0)


def _may_link(percent: int, differ: Column) -> Column:
    """Pairs (n_a, n_b) whose sizes, and a lower bound of their difference, allow a link."""
    both = F.col("n_a") + F.col("n_b")
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & ((100 + percent) * differ <= (100 - percent) * both)


def _sent(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it is small."""
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


class _Verifier:
    """Reads the sets of candidate classes and sums partial overlaps."""

    def __init__(self, docs: DataFrame, classes: DataFrame, width: int, percent: int):
        self.docs, self.classes, self.width, self.percent = docs, classes, width, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the written pairs (a, b, n_a, n_b) that link. Fragments with equal digests hold the same shingles; of
        the others the segments meet, and what of a isn't in b is summed over them."""
        known = lambda side: self.classes.select(F.col("c").alias(side), F.col("parts").alias(f"p_{side}"), F.col("wide").alias(f"w_{side}"))
        both = pairs.join(known("a"), "a").join(known("b"), "b").where(_may_link(self.percent, _wide_differ()))
        differ = F.filter(F.sequence(F.lit(0), F.lit(_FRAGMENTS - 1)), lambda f: F.get("p_a", f) != F.get("p_b", f))
        pairs = cut(both.select("a", "b", "n_a", "n_b", differ.alias("fragments")), "pairs")
        differ = pairs.select("a", "b", F.explode("fragments").alias("fragment"))

        either = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
        needed = cut(self.classes.select("c", "fp", F.col("min_id").alias("id")).join(either, "c"), "needed")
        own = _segments(self.docs.join(_sent(needed), "id"), self.width).dropDuplicates(["c", "fragment"])
        # One exchange by (class, fragment) serves both sides.
        left = own.select(F.col("c").alias("a"), "fragment", F.col("segment").alias("of_a"))
        right = own.select(F.col("c").alias("b"), "fragment", F.col("segment").alias("of_b"))
        rest = differ.hint("merge").join(left, ["a", "fragment"]).hint("merge").join(right, ["b", "fragment"], "left")
        rest = rest.select("a", "b", F.when(F.col("of_b").isNull(), F.size("of_a")).otherwise(F.size(F.array_except("of_a", "of_b"))).alias("rest"))
        total = pairs.drop("fragments").join(rest.groupBy("a", "b").agg(F.sum("rest").alias("rest")), ["a", "b"], "left")
        common = F.col("n_a") - F.coalesce("rest", F.lit(0))
        linked = total.where(100 * common >= self.percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")
        with small_batches(self.docs.sparkSession):
            links = cut(linked, "links")
        drop_table(pairs)
        drop_table(needed)
        sweep(self.docs.sparkSession)
        return links


def _across(members: DataFrame, roots: DataFrame, of, percent: int, nearest: bool) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of members of a bucket that are in different components and may link: for each two
    components the pair whose sketches differ least, or all."""
    placed = members.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    placed = cut(placed, "placed")
    several = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") < F.col("hi")).select("sig")
    open_ = cut(placed.join(several, "sig").join(of("c").select("c", F.col("n_c").alias("n"), F.col("s_c").alias("s")), "c"), "open")
    side = lambda x: open_.select("sig", F.col("c").alias(x), F.col("root").alias(f"r_{x}"), F.col("n").alias(f"n_{x}"), F.col("s").alias(f"s_{x}"))
    pairs = side("a").join(side("b"), "sig").where((F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & _may_link(percent, _differ()))
    if not nearest:
        return pairs.select("a", "b", "n_a", "n_b").distinct()
    two = pairs.groupBy(F.least("r_a", "r_b"), F.greatest("r_a", "r_b")).agg(F.min(F.struct(_differ().alias("differ"), "a", "b", "n_a", "n_b")).alias("p"))
    return two.select("p.a", "p.b", "p.n_a", "p.n_b").distinct()


def join_documents(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_shingles, component_id (the smallest id reachable by links of at least percent/100)."""
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    spark = df.sparkSession
    with small_batches(spark):
        sets = cut(_sets(df, id_col, text_col, width, percent), "sets")
    known = sets.where(F.col("fp").isNotNull() & F.col("id").isNotNull())
    classes = known.groupBy("fp").agg(F.min("id").alias("min_id"), F.max("n").alias("n"), F.max("short").alias("short"))
    classes = cut(classes.withColumn("c", F.monotonically_increasing_id()), "classes")

    # A set is filed by half of its fingerprint; another that shares the half only becomes one more candidate. A set that
    # has null ids alone is no class, and goes as its half is looked up.
    filed = sets.where(F.col("sigs").isNotNull()).select(F.explode("sigs").alias("sig"), "short")
    live = cut(_shared(filed), "shared")
    sweep(spark)
    members = cut(live.join(classes.select("short", "c"), "short").select("sig", "c").distinct(), "members")
    drop_table(live)
    # From here on only sets with company matter, and of all rows what the result takes.
    company = classes.select("c", "fp", "min_id", "n").join(members.select("c").distinct(), "c", "left_semi")
    drawn = sets.where(F.col("sigs").isNotNull()).select("fp", "sketch", "wide", "parts").join(company, "fp")
    details = cut(drawn.dropDuplicates(["c"]), "details")
    named = cut(sets.select("id", "n", F.when(F.col("id").isNotNull(), F.col("fp")).alias("fp")), "rows")
    drop_table(sets)
    sets = named
    sweep(spark)

    verifier = _Verifier(docs, details, width, percent)
    of = lambda side: details.select(F.col("c").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}"))
    # The pivot is the member whose buckets are the largest: of a text's near copies the one that most of them resemble.
    size = cut(members.groupBy("sig").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1), "sizes")
    weight = members.join(size, "sig").groupBy("c").agg(F.sum("size").alias("weight"))
    pivot = members.join(weight, "c").groupBy("sig").agg(F.max(F.struct("weight", "c"))["c"].alias("a"))
    star = members.join(pivot, "sig").where(F.col("c") != F.col("a")).select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
    star = cut(star.join(of("b"), "b").join(of("a"), "a").where(_may_link(percent, _differ())).select("a", "b", "n_a", "n_b"), "star")
    first = verifier.links(star)
    roots = components(first)
    sweep(spark)

    # Of each two components that still share a bucket the pair with the closest sketches comes first; then all pairs
    # that are left, so that no link between components is lost.
    found, tried = first, star
    for nearest in (True, False):
        across = cut(_across(members, roots, of, percent, nearest).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "across")
        if across.isEmpty():
            break
        more = verifier.links(across)
        tried = tried.unionByName(across)
        if not more.isEmpty():
            found = found.unionByName(more)
            roots = components(found)

    named = classes.select("c", "fp", "min_id").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = named.groupBy("root").agg(F.min("min_id").alias("component_id"))
    named = named.join(smallest, "root").select("fp", "component_id")
    out = sets.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
