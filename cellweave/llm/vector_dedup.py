"""Near-duplicate vectors of equal label by an inverted multi-index.

Unit vectors are cut into halves, each with a codebook of its own (k-means on a bounded sample: the `sample` valid
rows with the smallest hash of the id). A pair of codewords is a cell of the product grid, and every vector is indexed
in the cell of its nearest codewords. A query visits cells by multi-sequence traversal, in the order of how far it
lies behind the borders between its own codewords and the cell's: a neighbour at distance d can only be in cells whose
borders are at most d away. The traversal ends at the distance within which the target share of simulated neighbours at the
threshold falls. Cosines in the visited cells are computed exactly, in double precision, so no link is below the
threshold; recall is measured against brute force in the tests.

Each found pair counts once for either end: a cell credits the query, and the indexed vector too unless that one
visits the query's cell itself. Pairs aren't listed. A cell returns, per vector that has links there, their number and the
smallest vector of its linked group, so a group of m like vectors costs O(m) rows. Large cells are split into blocks of
indexed vectors and of queries.

Vectors that are null, zero, or hold null or non-finite components, rows with a null label, and rows with a null id
link with nothing. Vectors of different lengths aren't compared. Rows that share an id share its results. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.components import components
from cellweave.llm.scratch import cut

_CELL_ROWS = 128  # vectors per cell that the codebooks aim at, labels together
_BLOCK = 4096  # indexed vectors, or queries, that meet at once


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Codewords of the rows of x, starting from rows spread over x; an empty codeword stays where it is."""
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _distances(x, words).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[n > 0] = sums[n > 0] / n[n > 0, None]
    return words


def _distances(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (words * words).sum(1) - 2 * x @ words.T, 0)


def _behind(x: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest codeword of each row, and how far behind each codeword's border the row lies (squared)."""
    d = _distances(x, words)
    own = d.argmin(1)
    apart = np.sqrt(_distances(words, words))
    with np.errstate(divide="ignore", invalid="ignore"):
        far = (d - d[np.arange(len(x)), own][:, None]) / (2 * apart[own])
    far[~np.isfinite(far)] = 0
    return own, far * far


def _traverse(first: np.ndarray, second: np.ndarray, reach: float) -> list[int]:
    """Cells in ascending order of first[i] + second[j], up to reach; the multi-sequence algorithm."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = a[first[a] <= reach], b[second[b] <= reach]
    width = len(second)
    heap, out = [(first[a[0]] + second[b[0]], 0, 0)], []
    while heap:
        s, i, j = heapq.heappop(heap)
        if s > reach:
            break
        out.append(int(a[i]) * width + int(b[j]))
        if i + 1 < len(a) and j == 0:  # a column is opened from its top only, so no cell comes twice
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
    return out


class Index:
    """Codebooks and traversal distance for one vector length."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float):
        half = sample.shape[1] // 2
        self.half = half
        self.books = (kmeans(sample[:, :half], k), kmeans(sample[:, half:], k)) if half else (np.zeros((1, 0)), kmeans(sample, min(k, len(sample))))
        rng = np.random.default_rng(7)
        x = sample[:2000]
        noise = rng.standard_normal(x.shape)
        noise -= (noise * x).sum(1)[:, None] * x
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * noise
        cost = 0
        for x_half, y_half, words in ((x[:, :half], y[:, :half], self.books[0]), (x[:, half:], y[:, half:], self.books[1])):
            cost = cost + _behind(x_half, words)[1][np.arange(len(x)), _behind(y_half, words)[0]]
        self.reach = float(np.quantile(cost, recall)) + 1e-12

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """Home cell and visited cells of each unit vector."""
        own_a, far_a = _behind(x[:, : self.half], self.books[0])
        own_b, far_b = _behind(x[:, self.half :], self.books[1])
        visits = [_traverse(p, q, self.reach) for p, q in zip(far_a, far_b, strict=True)]
        return own_a * far_b.shape[1] + own_b, visits


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length, none null, as rows, without a Python object per number."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _meet(table: pa.Table, cosine: float, schema_names: list[str], id_type: pa.DataType) -> pa.Table:
    """Links between the queries and the indexed vectors of one block."""
    indexed = table.column("indexed").to_numpy(zero_copy_only=False).astype(bool)
    home = table.column("home").to_numpy()
    x = _units(_matrix(table.column("vec")))
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    t, q = np.flatnonzero(indexed), np.flatnonzero(~indexed)
    counts = np.zeros(len(x), np.int64)
    # A vector that is both indexed and a query is one node; a group is the smallest place among its nodes.
    by_id: dict = {}
    node = np.array([by_id.setdefault(name, len(by_id)) for name in ids], np.int64)
    group = np.arange(len(x))

    visits = [set(v) if v is not None else None for v in table.column("visits").to_pylist()]
    homes, home_code = np.unique(home, return_inverse=True)
    visited = np.zeros((len(t), len(homes)), bool)
    for row, i in enumerate(t):
        visited[row] = [h in visits[i] for h in homes.tolist()]
    for at in range(0, len(q), 512):
        block = q[at : at + 512]
        near = x[block] @ x[t].T >= cosine
        near &= ids[block][:, None] != ids[t][None, :]
        counts[block] += near.sum(1)
        once = near & ~visited[:, home_code[block]].T
        counts[t] += once.sum(0)
        for row, i in enumerate(block):
            if near[row].any():
                met = np.unique(np.append(group[node[t[near[row]]]], group[node[i]]))
                if len(met) > 1:  # in a group that is known as one, nothing is left to join
                    group[np.isin(group, met[1:])] = met[0]
    linked = np.flatnonzero(counts)
    # Vectors with no credit here may still be part of a group: an indexed one whose link is credited elsewhere.
    own = group[node]
    by_group = np.argsort(own, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(own[by_group]) != 0)) if len(own) else []
    group = {}
    for members in np.split(by_group, starts[1:]) if len(own) else ():
        names = set(ids[members].tolist())
        if len(names) > 1:
            group |= dict.fromkeys(members.tolist(), min(names))
    rows = [(ids[i], int(counts[i]), group.get(i)) for i in sorted({*linked.tolist(), *group})]
    cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.table([pa.array(cols[0], id_type), pa.array(cols[1], pa.int64()), pa.array(cols[2], id_type)], names=schema_names)


def link(df: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", recall: float = 0.999, sample: int = 20_000) -> DataFrame:
    """Per row: id_col, n_links, component_id (the smallest id reachable by links), kept."""
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & F.exists("vec", lambda v: v != 0)
    valid = rows.where(usable)

    n = valid.count()
    taken = [r["vec"] for r in valid.select("vec", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(sample).collect()]
    by_length = defaultdict(list)
    for v in taken:
        by_length[len(v)].append(v)
    indexes = {size: Index(_units(np.array(own, np.float64)), max(1, min(int((n / _CELL_ROWS) ** 0.5), len(own) // 16)), cosine, recall) for size, own in by_length.items()}
    sent = spark.sparkContext.broadcast(indexes)

    placed = T.StructType([T.StructField("id", id_type), T.StructField("label", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("home", T.LongType()), T.StructField("visits", T.ArrayType(T.LongType())), T.StructField("vec", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vec")
            home, visits = [0] * len(vectors), [[0]] * len(vectors)
            lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths).tolist():
                if size in sent.value:  # a length that the sample lacks has one cell
                    at = np.flatnonzero(lengths == size)
                    h, v = sent.value[size].cells(_units(_matrix(vectors.take(pa.array(at)))))
                    for i, own, seen in zip(at, h.tolist(), v, strict=True):
                        home[i], visits[i] = own, seen
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(lengths, pa.int32()), pa.array(home, pa.int64()), pa.array(visits, pa.list_(pa.int64())), batch.column("vec")], names=placed.names)

    grid = cut(valid.mapInArrow(place, placed), "grid")
    asked = grid.withColumn("cell", F.explode("visits"))
    cell = ["label", "size", "cell"]
    sizes = grid.groupBy("label", "size", F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("n_t"))
    queries = asked.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / _BLOCK).alias("n_q"))
    sizes = cut(sizes.join(queries, cell), "cells")  # cells that are both filled and visited
    part = lambda of: F.pmod(F.xxhash64("id"), F.col(of))
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    nothing = F.lit(None).cast("array<bigint>")
    indexed = grid.withColumn("cell", F.col("home")).join(sizes, cell).withColumn("t", part("n_t")).withColumn("q", every("n_q")).withColumn("indexed", F.lit(True))
    asking = asked.withColumn("visits", nothing).join(sizes, cell).withColumn("q", part("n_q")).withColumn("t", every("n_t")).withColumn("indexed", F.lit(False))
    columns = [*cell, "t", "q", "id", "home", "visits", "vec", "indexed"]
    found = T.StructType([T.StructField("id", id_type), T.StructField("n", T.LongType()), T.StructField("root", id_type)])
    names = found.names

    def meet(table: pa.Table) -> pa.Table:
        return _meet(table, cosine, names, table.schema.field("id").type)

    links = cut(indexed.select(columns).unionByName(asking.select(columns)).groupBy(*cell, "t", "q").applyInArrow(meet, found), "links")
    counts = links.groupBy("id").agg(F.sum("n").alias("n_links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = counts.join(roots.withColumnRenamed("node", "id"), "id", "full")
    out = rows.select("id", usable.alias("usable")).join(named, "id", "left")
    component = F.when(F.col("usable"), F.coalesce("root", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.when(F.col("usable"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
