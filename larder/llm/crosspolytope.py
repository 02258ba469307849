"""Near-duplicate vectors by cross-polytope hashing.

A vector is turned by sign flips and fast Hadamard transforms, three times over; the axis it then lies nearest to, with
its sign, is its hash. Several such axes make a bucket, several tables make a pair of near vectors meet, and a vector
also visits the buckets of its next nearest axes. Pairs that meet are verified by cosine in double precision inside the
task; a pair counts in the first table and bucket where it meets, so links are counted without a row per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.components import components
from larder.llm.groups import roots, whole_groups
from larder.llm.vectors import matrices, usable
from larder.session import cut_lineage

COSINE = 0.98
TABLES = 16
PROBES = 3
SEED = 98
#: Vectors that a bucket is to hold on average, which sets how many axes make a bucket.
BUCKET_VECTORS = 64
#: Rows of a bucket that one task compares; a larger bucket is split into slices, and each two slices meet in a task.
SLICE_ROWS = 1024
SMALL_GROUP = 48
ROWS = "part long, dim int, t int, code long, resident boolean, k1 long, k2 long, n long, vector binary, codes binary"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    x, step, n = x.copy(), 1, x.shape[1]
    while step < n:
        y = x.reshape(len(x), n // (2 * step), 2, step)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


def bucket_codes(x: np.ndarray, tables: int, axes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """For each vector and table its own bucket, then the next ``probes - 1`` ones by how much nearness they give up."""
    size = max(2, 1 << max(1, x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size))
    padded[:, : x.shape[1]] = x / np.linalg.norm(x, axis=1)[:, None]
    out = np.zeros((len(x), tables, probes), dtype=np.int64)
    rng = np.random.default_rng([seed, size])
    rows = np.arange(len(x))
    for t in range(tables):
        best, loss, second = [], [], []
        for _ in range(axes):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2] if size > 2 else np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            swap = np.abs(y[rows, top[:, 0]]) < np.abs(y[rows, top[:, 1]])
            top[swap] = top[swap][:, ::-1]
            a, b = y[rows, top[:, 0]], y[rows, top[:, 1]]
            best.append(2 * top[:, 0] + (a < 0))
            second.append(2 * top[:, 1] + (b < 0))
            loss.append(np.abs(a) - np.abs(b))
        weight = [(2 * size) ** k for k in range(axes)]
        own = sum(b * w for b, w in zip(best, weight, strict=True))
        out[:, t, :] = own[:, None]
        order = np.argsort(np.stack(loss, axis=1), axis=1, kind="stable")
        change = np.stack([(s - b) * w for s, b, w in zip(second, best, weight, strict=True)], axis=1)
        for p in range(1, min(probes, axes + 1)):
            out[:, t, p] = own + change[rows, order[:, p - 1]]
    return out


def _hash(tables: int, axes: int, probes: int, code_type: str):
    names = [x.split()[0] for x in ROWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                column = pa.concat_arrays([batch.column(4)])
                for rows, x in matrices(column):
                    codes = bucket_codes(x.astype(np.float64), tables, axes, probes)
                    n, t = len(rows), tables
                    # a row per table and different bucket
                    fresh = np.ones((n, t, probes), dtype=bool)
                    for p in range(1, probes):
                        fresh[:, :, p] = (codes[:, :, :p] != codes[:, :, p : p + 1]).all(axis=2)
                    i, tt, p = np.nonzero(fresh)
                    raw = [v.tobytes() for v in x.astype("<f4")]
                    own = [c.astype(code_type).tobytes() for c in codes]
                    pick = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pick), pa.array(np.full(len(i), x.shape[1], np.int32)), pa.array(tt.astype(np.int32)),
                        pa.array(codes[i, tt, p]), pa.array(p == 0), batch.column(1).take(pick), batch.column(2).take(pick),
                        batch.column(3).take(pick), pa.array([raw[j] for j in i], pa.binary()), pa.array([own[j] for j in i], pa.binary())], names)

    return run


def _first_meeting(x: np.ndarray, y: np.ndarray, t: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether table ``t`` and bucket ``code`` are the first where two vectors meet, by their codes alone."""
    x_visits = (y[:, :, :1] == x).any(axis=2)  # x comes to y's own bucket
    y_visits = (x[:, :, :1] == y).any(axis=2)
    first = np.argmax(x_visits | y_visits, axis=1)
    rows = np.arange(len(x))
    far = np.iinfo(np.int64).max
    there = np.minimum(np.where(x_visits[rows, t], y[rows, t, 0], far), np.where(y_visits[rows, t], x[rows, t, 0], far))
    return (first == t) & (there == code)


def _verify(cosine: float, tables: int, probes: int, code_type: str):
    """Links of the vectors of each bucket: per vector how many, and the least vector that it reaches in this task."""
    names = ["k1", "k2", "links", "r1", "r2"]

    def pairs(start: int, stop: int, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.nonzero(unit[start:stop] @ unit[start:stop].T >= cosine - 1e-9)
        keep = x < y
        return x[keep] + start, y[keep] + start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["part", "dim", "t", "code", "i", "j"]):
            yield from group(table, edges)

    def group(table: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(edges)
        if not (sizes > 1).any():
            return
        keep = np.repeat(sizes > 1, sizes)
        table = table.filter(pa.array(keep))
        sizes = sizes[sizes > 1]
        edges = np.append(0, np.cumsum(sizes))
        of = np.repeat(np.arange(len(sizes)), sizes)
        column = lambda k: table.column(k).combine_chunks()
        dims = column("dim").to_numpy()
        codes = np.frombuffer(b"".join(column("codes").to_pylist()), dtype=code_type).reshape(len(of), tables, probes)
        raw = column("vector").to_pylist()
        xs, ys = [], []
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)  # neighbouring rows, as the dimension is part of the order
            unit = np.frombuffer(b"".join([raw[k] for k in at]), dtype="<f4").reshape(len(at), dim).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1)[:, None]
            where = np.zeros(len(of), dtype=np.int64)
            where[at] = np.arange(len(at))
            small = at[sizes[of[at]] <= SMALL_GROUP]
            for step in range(1, SMALL_GROUP):
                a = small[small + step < len(of)]
                a = a[of[a] == of[a + step]]
                if not len(a):
                    break
                a = a[np.einsum("ij,ij->i", unit[where[a]], unit[where[a + step]]) >= cosine - 1e-9]
                xs.append(a)
                ys.append(a + step)
            for g in np.unique(of[at][sizes[of[at]] > SMALL_GROUP]):
                a, b = edges[g], edges[g + 1]
                x, y = pairs(where[a], where[a] + b - a, unit)
                xs.append(x - where[a] + a)
                ys.append(y - where[a] + a)
            if not xs:
                continue
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
        resident, salt = column("resident").to_numpy(zero_copy_only=False), column("salt").to_numpy()
        one_slice = column("i").to_numpy() == column("j").to_numpy()
        ok = (resident[x] | resident[y]) & (one_slice[x] | (salt[x] != salt[y]))
        x, y = x[ok], y[ok]
        if not len(x):
            return
        t, code = column("t").to_numpy(), column("code").to_numpy()
        ok = _first_meeting(codes[x].astype(np.int64), codes[y].astype(np.int64), t[x], code[x])
        x, y = x[ok], y[ok]
        if not len(x):
            return
        # the exact cosine decides: components in double precision, summed in their order
        ok = exact_cosines([raw[k] for k in x], [raw[k] for k in y]) >= cosine
        x, y = x[ok], y[ok]
        k1, k2, n = column("k1").to_numpy(), column("k2").to_numpy(), column("n").to_numpy()
        links = np.zeros(len(of), dtype=np.int64)
        np.add.at(links, x, n[y])
        np.add.at(links, y, n[x])
        root = roots(len(of), x, y)
        own = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k1[own], k2[own], links[own], k1[root[own]], k2[root[own]])], names)

    return run


def exact_cosines(a: list[bytes], b: list[bytes]) -> np.ndarray:
    out = np.zeros(len(a))
    sizes = np.array([len(v) for v in a])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        x, y = (np.frombuffer(b"".join([v[k] for k in rows]), dtype="<f4").reshape(len(rows), size // 4).astype(np.float64) for v in (a, b))
        dot, xx, yy = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
        for k in range(size // 4):
            dot += x[:, k] * y[:, k]
            xx += x[:, k] * x[:, k]
            yy += y[:, k] * y[:, k]
        out[rows] = dot / (np.sqrt(xx) * np.sqrt(yy))
    return out


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
                 bucket_vectors: int = BUCKET_VECTORS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Links between vectors of equal label and their components: a row per row with ``vec_id, n_links, component_id, kept``.

    Vectors that are null, zero or hold a null or non-finite component, and rows with a null label, link with nothing and
    are their own component. Rows with the same label and vector are compared once and count as vectors of their own;
    vectors of different dimensions never link. ``component_id`` is the least ``vec_id`` reached (null ids are passed
    over; null if there is no other). Other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    rows = rows.withColumn("takes", usable() & F.col("label").isNotNull())
    rows = rows.withColumns({"k1": F.when(F.col("takes"), F.xxhash64("label", "embedding")),
                             "k2": F.when(F.col("takes"), F.xxhash64(F.lit(1), "label", "embedding"))})
    kinds = rows.where("takes").groupBy("k1", "k2").agg(
        F.first(F.xxhash64("label")).alias("part"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least"))
    kinds = cut_lineage(kinds)
    largest = kinds.groupBy("part").count().agg(F.max("count")).first()[0] or 1
    dim = kinds.agg(F.max(F.size("embedding"))).first()[0] or 2
    axis = math.log(2 * max(2, 1 << (dim - 1).bit_length()))
    axes = max(1, min(int(62 * math.log(2) / axis), math.ceil(math.log(max(2, largest / bucket_vectors)) / axis)))
    code_type = "<i4" if axes * axis < 31 * math.log(2) else "<i8"
    dealt = kinds.select("part", "k1", "k2", "n", "embedding").mapInArrow(_hash(tables, axes, probes, code_type), ROWS)
    key = ["part", "dim", "t", "code"]
    full = dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > slice_rows)
    full = full.select(*key, F.ceil(F.col("rows") / slice_rows).cast("int").alias("slices"))
    dealt = dealt.join(full, key, "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("k2"), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumns({"i": F.least("salt", "other"), "j": F.greatest("salt", "other")}).drop("slices", "other")
    met = dealt.repartition(*key, "i", "j").sortWithinPartitions(*key, "i", "j")
    links = met.mapInArrow(_verify(cosine, tables, probes, code_type), "k1 long, k2 long, links long, r1 long, r2 long")
    links = cut_lineage(links)
    counts = links.groupBy("k1", "k2").agg(F.sum("links").alias("links"))
    parts = components(links.select(F.struct("k1", "k2").alias("x"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("y")), "x", "y")
    parts = parts.select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "component")
    kinds = kinds.drop("embedding").join(counts, ["k1", "k2"], "left").join(parts, ["k1", "k2"], "left")
    kinds = kinds.withColumn("component", F.coalesce("component", F.struct("k1", "k2")))
    least = kinds.groupBy("component").agg(F.min("least").alias("component_id"))
    kinds = kinds.join(least, "component").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component_id")
    out = rows.select("vec_id", "takes", "k1", "k2").join(kinds, ["k1", "k2"], "left")
    component = F.when(F.col("takes"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
