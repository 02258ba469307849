"""Hard negatives: rows of another label whose score with an anchor lies in a window below that of one of its positives.

Anchors are dealt into tiles, and each tile has a spanning tree of least total edge length over its anchors. Rows are dealt
into blocks, and each tile meets each block once. The root of a tree is scored against all rows of the block; from there
on, a row's score with a child lies within the edge's length times the row's norm of its score with the parent. Only rows
whose bounds reach into what is asked for are scored again, exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.llm.textbuf import give_back
from larder.llm.vectors import matrices
from larder.session import cut_lineage

POSITIVES = 5
NEGATIVES = 10
SCALE = 256
#: A negative's score is at least ``LOW`` and at most ``HIGH`` hundredths of the positive's.
LOW, HIGH = 30, 90
BLOCK_ROWS = 1 << 14
TILE_ANCHORS = 512
_MOST = (1 << 63) - 1


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components times ``scale``, rounded down, in double precision; still whole numbers where a long can't hold them."""
    return np.floor(vectors.astype(np.float64) * scale)


class Rows:
    """Rows of one dimension: ids, labels, whole components and norms."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray):
        self.ids, self.labels, self.codes = ids, labels, codes
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((codes * codes).sum(axis=1))

    def scores(self, pick: np.ndarray, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products of some rows with an anchor; a sum beyond a long's range counts as that range's end."""
        if not len(pick):
            return np.empty(0, dtype=np.int64)
        codes = self.codes if len(pick) == len(self.ids) else self.codes[pick]
        # by Cauchy and Schwarz no part of the sum leaves the range where doubles hold every whole number
        if norm * float(self.norms[pick].max()) < 1 << 52:
            return (codes @ anchor).astype(np.int64)
        other = [int(x) for x in anchor]
        sums = (sum(int(x) * y for x, y in zip(row, other, strict=True)) for row in codes)
        return np.array([max(-_MOST - 1, min(_MOST, x)) for x in sums], dtype=np.int64)


def spanning_tree(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors from the first one on, each after its parent: their order, parents (-1 for the first) and edge lengths."""
    n = len(codes)
    order, parent, length = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.zeros(n)
    near, by, open_ = np.full(n, np.inf), np.full(n, -1, np.int64), np.ones(n, dtype=bool)
    now = 0
    for k in range(n):
        order[k], parent[now], length[now] = now, by[now], 0.0 if by[now] < 0 else near[now]
        open_[now] = False
        with np.errstate(over="ignore"):
            gap = np.sqrt(((codes - codes[now]) ** 2).sum(axis=1))
        closer = open_ & (gap < near)
        near[closer], by[closer] = gap[closer], now
        by[open_ & (by < 0)] = now  # distances that overflow: any parent will do
        now = int(np.where(open_, near, np.inf).argmin()) if open_.any() else 0
        if not open_[now] and open_.any():
            now = int(open_.argmax())
    return order, parent, length


def _nth_largest(x: np.ndarray, n: int) -> float:
    return -np.inf if len(x) < n else float(np.partition(x, len(x) - n)[len(x) - n])


def _first(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores, ties to the smaller id."""
    return np.lexsort((ids, ~scores))[:n]


class Walk:
    """Bounds of a block's scores with the anchors of a tile, from parents to children."""

    def __init__(self, anchors: Rows, rows: Rows, tree: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.anchors, self.rows, (self.order, self.parent, self.length) = anchors, rows, tree
        self.bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=len(anchors.ids))
        self.all = np.arange(len(rows.ids))
        self.scored = 0

    def __iter__(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each anchor with the least and greatest score that each row may have with it."""
        for a in self.order.tolist():
            p = int(self.parent[a])
            if p < 0:
                self.bounds[a] = (np.empty(0), np.empty(0))
                self.exact(a, self.all)
            else:
                low, high = self.bounds[p]
                # sums of doubles round, and a score that is cut to a long is still within its bounds
                with np.errstate(over="ignore", invalid="ignore"):
                    slack = self.length[a] * self.rows.norms * (1 + 1e-9) + 1e-9 * np.maximum(np.abs(low), np.abs(high)) + 1
                    low, high = low - slack, high + slack
                self.bounds[a] = (np.where(np.isnan(low), -np.inf, low), np.where(np.isnan(high), np.inf, high))
                self.children[p] -= 1
                if not self.children[p]:
                    del self.bounds[p]
            yield a, *self.bounds[a]
            if not self.children[a]:
                self.bounds.pop(a, None)

    def exact(self, a: int, pick: np.ndarray) -> np.ndarray:
        """Exact scores of some rows with an anchor; its bounds become these."""
        if 2 * len(pick) > len(self.all):  # one product over all rows costs less, and makes the children's bounds better
            scores = self.rows.scores(self.all, self.anchors.codes[a], float(self.anchors.norms[a]))
            exact = scores.astype(np.float64)
            self.bounds[a] = (exact, exact)
            self.scored += len(self.all)
            return scores[pick]
        scores = self.rows.scores(pick, self.anchors.codes[a], float(self.anchors.norms[a]))
        low, high = self.bounds[a]
        low[pick] = high[pick] = scores
        self.scored += len(pick)
        return scores


def positives_of(walk: Walk, n: int) -> Iterator[tuple[int, int, int]]:
    """For each anchor the first ``n`` rows of its label in the block: anchor id, row id, score."""
    anchors, rows = walk.anchors, walk.rows
    for a, low, high in walk:
        same = np.flatnonzero((rows.labels == anchors.labels[a]) & (rows.ids != anchors.ids[a]))
        if not len(same):
            continue
        pick = same[high[same] >= _nth_largest(low[same], n)]
        scores = walk.exact(a, pick)
        for k in _first(scores, rows.ids[pick], n).tolist():
            yield int(anchors.ids[a]), int(rows.ids[pick[k]]), int(scores[k])


def negatives_of(walk: Walk, windows: list[list[tuple[int, int]]], n: int, low_: int, high_: int) -> Iterator[tuple[int, int, int, int, int]]:
    """For each anchor and positive the first ``n`` rows of other labels in its window: anchor, positive, its score, row, score."""
    anchors, rows = walk.anchors, walk.rows
    for a, low, high in walk:
        if not windows[a]:
            continue
        other = rows.labels != anchors.labels[a]
        asked = np.zeros(len(rows.ids), dtype=bool)
        edges = []
        for _, score in windows[a]:
            least, most = -(-low_ * score // 100), high_ * score // 100
            edges.append((least, most))
            if least <= most:
                sure = other & (low >= least) & (high <= most)
                asked |= other & (high >= max(least, _nth_largest(low[sure], n))) & (low <= most)
        pick = np.flatnonzero(asked)
        if not len(pick):
            continue
        scores = walk.exact(a, pick)
        for (positive, score), (least, most) in zip(windows[a], edges, strict=True):
            inside = np.flatnonzero((scores >= max(least, -_MOST - 1)) & (scores <= min(most, _MOST))) if least <= most else np.empty(0, np.int64)
            for k in inside[_first(scores[inside], rows.ids[pick[inside]], n)].tolist():
                yield int(anchors.ids[a]), positive, score, int(rows.ids[pick[k]]), int(scores[k])


TILE = "tile int, size int, ids binary, labels binary, codes binary, order binary, parent binary, length binary, windows array<array<struct<id:long,score:long>>>"


def _pack_tiles(scale: int):
    """Anchors of a tile and dimension as one row, with their spanning tree and windows."""
    names = [x.split()[0] for x in TILE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            vectors = table.column("embedding").combine_chunks()
            for place, x in matrices(vectors):
                rows = table.take(pa.array(place))
                codes = whole(x, scale)
                order, parent, length = spanning_tree(codes)
                one = lambda v: pa.array([v.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rows.column("tile")[0].as_py()], pa.int32()), pa.array([x.shape[1]], pa.int32()),
                     one(rows.column("vec_id").to_numpy()), one(rows.column("label").to_numpy().astype(np.int64)), one(codes),
                     one(order), one(parent), one(length),
                     pa.array([[w or [] for w in rows.column("windows").to_pylist()]],
                              pa.list_(pa.list_(pa.struct([("id", pa.int64()), ("score", pa.int64())]))))], names)

        for batch in batches:  # sorted by tile
            tiles = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(tiles)) + 1).tolist(), len(tiles)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1].column(0)[0].as_py() != tiles[a]:
                    yield from pack()
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from pack()
        give_back()

    return run


def _meet(negatives: int | None, positives: int, low: int, high: int, scale: int):
    """Tiles stream past the rows of their block, which come first."""
    names = ["anchor_id", "positive_id", "positive_score"] + ["negative_id", "negative_score"] * (negatives is not None)

    def blocks(held: list[pa.RecordBatch]) -> dict[int, Rows]:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy().astype(np.int64)
        return {x.shape[1]: Rows(ids[at], labels[at], whole(x, scale)) for at, x in matrices(table.column("embedding").combine_chunks())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, rows = None, {}
        for batch in batches:
            block, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(kind) != 0)) + 1).tolist(), len(block)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block[a] != now:
                    now, held, rows = block[a], [], {}
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    rows, held = blocks(held), []
                for k in range(a, b):
                    get = lambda name, k=k: batch.column(name)[k].as_py()
                    if get("size") not in rows:
                        continue
                    read = lambda name, t=np.int64: np.frombuffer(get(name), dtype=t)
                    ids = read("ids")
                    anchors = Rows(ids, read("labels"), read("codes", np.float64).reshape(len(ids), -1))
                    walk = Walk(anchors, rows[get("size")], (read("order"), read("parent"), read("length", np.float64)))
                    if negatives is None:
                        found = list(positives_of(walk, positives))
                    else:
                        windows = [[(w["id"], w["score"]) for w in own] for own in get("windows")]
                        found = list(negatives_of(walk, windows, negatives, low, high))
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names)
        give_back()

    return run


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH, scale: int = SCALE, block_rows: int = BLOCK_ROWS, tile_anchors: int = TILE_ANCHORS) -> DataFrame:
    """Negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A score is the inner product of components times ``scale`` rounded down; higher ones come first, ties go to the smaller
    ``vec_id``. An anchor's positives are its first rows of the same label, its negatives for one of them the first rows of
    other labels with ``low * positive_score <= 100 * negative_score <= high * positive_score``. Rows whose id or label is
    null, and vectors that are null or hold a null or non-finite component, take no part; zero vectors do. Rows of one
    ``vec_id`` are one row, the least by vector and label. Vectors of different dimensions have no score. A score beyond the
    range of a long counts as that range's end. A positive without negatives has no row. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "embedding", "label", is_anchor.alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("embedding", "label", "anchor")).alias("row"))
    rows = cut_lineage(rows.select("vec_id", F.col("row.label").cast("long").alias("label"), "row.embedding", "row.anchor"))
    total, asking = rows.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks, tiles = max(1, -(-total // block_rows)), max(1, -(-asking // tile_anchors))
    tile = F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(tiles)).cast("int").alias("tile")
    own = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "label", "embedding")
    anchors = rows.where("anchor").select(tile, "vec_id", "label", "embedding")

    def met(anchors: DataFrame, wanted: int | None, schema: str) -> DataFrame:
        packed = anchors.repartition(tiles, "tile").sortWithinPartitions("tile", "vec_id").mapInArrow(_pack_tiles(scale), TILE)
        dealt = packed.withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), "kind": F.lit(1)})
        both = own.unionByName(dealt, allowMissingColumns=True).repartition(blocks, "block").sortWithinPartitions("block", "kind")
        return both.mapInArrow(_meet(wanted, positives, low, high, scale), schema)

    none = F.lit(None).cast("array<struct<id:long,score:long>>")
    near = met(anchors.withColumn("windows", none), None, "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    windows = near.groupBy("anchor_id").agg(F.collect_list(F.struct(F.col("positive_id").alias("id"), F.col("positive_score").alias("score"))).alias("windows"))
    asked = anchors.join(windows.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    found = met(asked, negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
