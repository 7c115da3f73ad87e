"""Best-fit packing of token pieces into sequences of a fixed capacity, by exact-complement hashing.

The plan needs the lengths only, and lengths are at most the capacity, so it works on a histogram of `capacity` counts
however many documents there are:

1. a piece of full length is a sequence;
2. the sums of one, two and three available lengths are indexed; for each length from the longest down the gap it leaves is
   looked up, and combinations that fill it exactly are consumed as often as the counts allow. A length
   that runs out leaves the index;
3. what remains is packed best-fit in decreasing order, again by counts.

Every consumption empties a length or a group of equal open sequences, so the plan has a number of runs that depends
on the capacity, not on the data, and can be sent to every task. A piece then finds its place by its rank among the
pieces of its length: (rows of that length in earlier partitions) + (rank inside its own), with no global sort.

Null texts count as empty: their piece is the end token alone. Repeated rows are packed each. Other columns are
ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm import bpe_automaton
from cellweave.llm.scratch import cut, small_batches

Pattern = list[tuple[int, int]]  # (length, how many of it side by side), in the sequence's order


class Sums:
    """Index of the sums of one, two and three available lengths.

    pair[s] and triple[s] mark the lengths that the sum s can start with: pair[s, a] if a and s - a are available, with
    a not the shorter, triple[s, a] if a is available and s - a is a pair's sum. A length that runs out is taken from both.
    """

    def __init__(self, n: np.ndarray, capacity: int):
        self.n, self.capacity = n, capacity
        self.have = n > 0
        self.pair = np.zeros((capacity + 1, capacity + 1), bool)
        self.triple = np.zeros((capacity + 1, capacity + 1), bool)
        lengths = np.flatnonzero(self.have)
        for a in lengths:
            b = lengths[(lengths <= a) & (lengths <= capacity - a)]
            self.pair[a + b, a] = True
            self.pair[2 * a : 2 * a + 1, a] = n[a] > 1
        self.pairs = self.pair.sum(axis=1)
        for a in lengths:
            self.triple[a:, a] = self.pairs[: capacity + 1 - a] > 0

    def one(self, s: int) -> list[list[int]]:
        return [[s]] if self.have[s] else []

    def two(self, s: int) -> Iterator[list[int]]:
        """Pairs of sum s, longest first part first; those that run out meanwhile are left out."""
        for a in np.flatnonzero(self.pair[s])[::-1].tolist():
            if self.pair[s, a]:
                yield [a, s - a]

    def three(self, s: int) -> Iterator[list[int]]:
        for a in np.flatnonzero(self.triple[s])[::-1].tolist():
            for rest in self.two(s - a):
                if not self.triple[s, a]:
                    break
                if rest[0] <= a:
                    yield [a, *rest]

    def take(self, x: int, k: int) -> None:
        """k pieces of length x are used."""
        self.n[x] -= k
        if self.n[x] == 1 and 2 * x <= self.capacity:
            self._lose(np.array([2 * x]), x)
        elif not self.n[x]:
            self.have[x] = False
            self.triple[:, x] = False
            sums = np.arange(x, self.capacity + 1)
            self._lose(sums, x)  # x was the longer part
            self._lose(sums, sums - x)  # or the shorter one

    def _lose(self, sums: np.ndarray, firsts) -> None:
        gone = self.pair[sums, firsts]
        self.pair[sums, firsts] = False
        self.pairs[sums] -= gone
        for s in sums[gone & (self.pairs[sums] == 0)].tolist():
            a = np.arange(self.capacity + 1 - s)
            self.triple[s + a, a] = False


def _exact(n: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Consume from the counts n what fills a sequence exactly with up to four pieces; (sequences, pattern) pairs."""
    plan = []
    index = Sums(n, capacity)

    def consume(lengths: list[int]) -> None:
        need = Counter(lengths)
        if times := min(int(n[x]) // k for x, k in need.items()):
            for x, k in need.items():
                index.take(x, times * k)
            plan.append((times, sorted(need.items(), reverse=True)))

    consume([capacity])
    for x in range(capacity - 1, 0, -1):
        for sums in (index.one, index.two, index.three):
            if not n[x]:
                break
            for rest in sums(capacity - x):
                consume([x, *rest])
                if not n[x]:
                    break
    return plan


def _best_fit(n: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Pack the counts n best-fit decreasing; equal sequences are kept as one group."""
    groups: dict[int, list[list]] = {}  # gap -> [how many sequences, pattern]
    gaps: list[int] = []

    def put(gap: int, times: int, pattern: Pattern) -> None:
        if gap not in groups:
            groups[gap] = []
            insort(gaps, gap)
        groups[gap].append([times, pattern])

    for x in range(capacity, 0, -1):
        left = int(n[x])
        while left:
            at = bisect_left(gaps, x)
            if at == len(gaps):  # none fits: new sequences take as many side by side as go in
                side = min(capacity // x, left)
                times = left // side
                put(capacity - side * x, times, [(x, side)])
                left -= times * side
                continue
            gap = gaps[at]
            times, pattern = groups[gap].pop()
            if not groups[gap]:
                del groups[gap]
                gaps.pop(at)
            side = min(gap // x, left)
            used = min(times, left // side)
            if used < times:
                put(gap, times - used, pattern)
            put(gap - side * x, used, [*pattern, (x, side)])
            left -= used * side
    return [(times, pattern) for entries in groups.values() for times, pattern in entries]


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Runs by (length, first rank): the pieces of `length` with ranks from `first` on stand `side` by side in sequences
    from `sequence` on, at offset `offset` and following."""
    n = np.zeros(capacity + 1, np.int64)
    for x, k in counts.items():
        n[x] += k
    patterns = _exact(n, capacity)
    patterns += _best_fit(n, capacity)
    used: Counter = Counter()
    runs, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for x, side in pattern:
            runs.append((x, used[x], sequence, offset, side))
            used[x] += times * side
            offset += x * side
        sequence += times
    runs.sort()
    table = np.array(runs, np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "sequence", "offset", "side"), table.T, strict=True)) | {"sequences": np.array([sequence])}


def pieces(df: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str, text_col: str, ids: bool) -> DataFrame:
    """Tokenize and cut; per piece its id, number, start, length, checksum, and its rank among the pieces of its length
    in this partition (part, nth). Depends on the partition's rows only, so a repeated task writes the same."""
    fields = [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("piece", T.IntegerType())] + [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "part", "nth")]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bpe_automaton.load(vocab_path, "merges")
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            take = []
            for i, text in enumerate(batch.column("__text")):
                raw = tokenizer.encode_bytes(text.as_py() or "") + end
                total, view = len(raw) // 4, memoryview(raw)
                at, piece = 0, 0
                while at < total:
                    length = min(capacity, (total - at - 1) % capacity + 1)
                    own = view[4 * at : 4 * (at + length)]
                    rows.append((piece, at, length, zlib.crc32(own), part, seen[length], *([own.cast("I").tolist()] if ids else [])))
                    seen[length] += 1
                    take.append(i)
                    at += length
                    piece += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * (len(fields) - 1)
            kinds = [pa.int32()] + [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column("__id").take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names=[f.name for f in fields])

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, T.StructType(fields))


def pack(df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Place every piece of every document in a sequence of at most `capacity` tokens.

    A document's ids are followed by end_id; one longer than the capacity is cut into pieces of the full capacity, of
    which the first may be shorter. Returns per piece id_col, piece, start, length, ids_crc32, sequence_id, offset,
    and ids if asked for. Sequences are gapless from offset 0.
    """
    with small_batches(df.sparkSession):
        written = cut(pieces(df, vocab_path, capacity, end_id, id_col, text_col, ids), "pieces")
    by_part = written.groupBy("part", "length").agg(F.max("nth").alias("last"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = cut(by_part.select("part", "length", (F.col("last") + 1).alias("n"), F.coalesce(F.sum(F.col("last") + 1).over(before), F.lit(0)).alias("base")), "counts")
    # At most `capacity` rows come to the driver.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(counts, capacity)
    sent = df.sparkSession.sparkContext.broadcast(runs)

    names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = T.StructType([written.schema[c] for c in names[:5]] + [T.StructField(c, T.LongType()) for c in names[5:]] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = sent.value
        low = np.searchsorted(runs["length"], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for x in np.unique(length):
                own = length == x
                a, b = low[x], low[x + 1]
                at[own] = a + np.searchsorted(runs["first"][a:b], rank[own], side="right") - 1
            nth, side = rank - runs["first"][at], runs["side"][at]
            sequence = runs["sequence"][at] + nth // side
            offset = runs["offset"][at] + length * (nth % side)
            cols = [batch.column(c) for c in names[:5]] + [pa.array(sequence), pa.array(offset)] + ([batch.column("ids")] if ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * ids)

    # The table grows with partitions x lengths, so it meets the pieces in a shuffle and is sent to nobody.
    ranked = written.join(by_part.select("part", "length", "base").hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.select(*names[:5], "rank", *["ids"] * ids).mapInArrow(place, schema)
