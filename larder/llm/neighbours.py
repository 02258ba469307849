"""Nearest neighbours by a block matrix join.

Rows are dealt into blocks; each query meets every block once, and streams past it. A block holds its vectors as int8 and,
for each, the norm of what rounding took away. A product of int8 tiles gives distances whose error these norms bound; a
pair that cannot be among a query's nearest of the block is dropped on that bound alone, the others are computed again
from the original components in double precision. Each block hands on the few nearest per query, picked with a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.vectors import matrices, usable

NEAREST = 10
BLOCK_ROWS = 4096
QUERY_TILE = 512
HITS = "query_id long, vec_id long, score double"


class Coded:
    """Vectors of one dimension with their int8 codes, scales and rounding errors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        x = vectors.astype(np.float64)
        self.scale = np.abs(x).max(axis=1) / 127
        self.scale = np.where(self.scale > 0, self.scale, 1.0)  # subnormal components
        self.codes = np.rint(x / self.scale[:, None]).astype(np.int8)
        self.error = np.sqrt(((x - self.codes * self.scale[:, None]) ** 2).sum(axis=1))
        self.square = (self.codes.astype(np.float64) ** 2).sum(axis=1) * self.scale**2

    def part(self, rows: slice) -> Coded:
        out = object.__new__(Coded)
        for name, value in vars(self).items():
            setattr(out, name, value[rows])
        return out


def distance_bounds(queries: Coded, block: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance that each pair's codes allow."""
    # sums of products of int8 are whole numbers that a float of this width holds exactly
    wide = np.float32 if block.codes.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = queries.codes.astype(wide) @ block.codes.T.astype(wide)
    square = queries.square[:, None] + block.square[None, :] - 2 * queries.scale[:, None] * block.scale[None, :] * product
    near = np.sqrt(np.maximum(square, 0))
    slack = queries.error[:, None] + block.error[None, :] + 1e-7 * np.sqrt(queries.square[:, None] + block.square[None, :])
    return near - slack, near + slack


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of row pairs, in double precision, components summed in their order."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        d = a[:, k].astype(np.float64) - b[:, k].astype(np.float64)
        total += d * d
    return np.sqrt(total)


def tile(queries: Coded, block: Coded, nearest: int) -> Iterator[tuple[int, int, float]]:
    """The nearest of a block for each query, ties to the smaller id; a row of the query's own id is passed over."""
    low, high = distance_bounds(queries, block)
    own = queries.ids[:, None] == block.ids[None, :]
    low[own] = high[own] = np.inf
    k = min(nearest, high.shape[1]) - 1
    bar = np.partition(high, k, axis=1)[:, k]
    q, c = np.nonzero((low <= bar[:, None]) & ~own)
    score = exact_distances(queries.vectors[q], block.vectors[c])
    cuts = np.searchsorted(q, np.arange(len(queries.ids) + 1))
    for n, query in enumerate(queries.ids.tolist()):
        a, b = cuts[n], cuts[n + 1]
        for s, i in heapq.nsmallest(nearest, zip(score[a:b].tolist(), block.ids[c[a:b]].tolist(), strict=True)):
            yield query, i, s


def _stream(nearest: int):
    """Rows of a partition come block by block, a block's own rows before the queries that stream past it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        coded: dict[int, Coded] = {}
        now = None
        for batch in batches:
            block, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (asks[1:] != asks[:-1]))), len(block))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if block[a] != now:
                    now, held, coded = block[a], {}, {}
                ids = batch.column(2).slice(a, b - a).to_numpy()
                for rows, x in matrices(batch.column(3).slice(a, b - a).combine_chunks() if isinstance(batch.column(3), pa.ChunkedArray) else pa.concat_arrays([batch.column(3).slice(a, b - a)])):
                    if not asks[a]:
                        held.setdefault(x.shape[1], []).append((ids[rows], x))
                        continue
                    if x.shape[1] not in coded:
                        if x.shape[1] not in held:
                            continue
                        coded[x.shape[1]] = Coded(*(np.concatenate(y) for y in zip(*held[x.shape[1]], strict=True)))
                    queries = Coded(ids[rows], x)
                    found = [h for t in range(0, len(rows), QUERY_TILE)
                             for h in tile(queries.part(slice(t, t + QUERY_TILE)), coded[x.shape[1]], nearest)]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, nearest: int = NEAREST, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The ``nearest`` rows by Euclidean distance of each row that ``is_query`` holds for, among all others.

    Returns ``query_id, rank, vec_id, score``. Rows whose id is null, and vectors that are null, zero or hold a null or
    non-finite component take no part. Rows of one ``vec_id`` are one vector, the least of theirs. Vectors of different
    dimensions are not compared. Equal distances go to the smaller id. A query without any candidate has no row.
    """
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-vectors.count() // block_rows))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    own = rows.select(block.alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asking = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "vec_id", "embedding")
    dealt = own.unionByName(asking).repartition(blocks, "block").sortWithinPartitions("block", "asks")
    hits = dealt.mapInArrow(_stream(nearest), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
