"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of word shingles. MinHash bands bring candidates together: texts that share a band, directly or through
others, form a candidate group. In a group each pair's MinHash values are compared a few at a time; a pair is dropped as
soon as the posterior probability, from a uniform prior, that its similarity reaches the threshold falls below a
tolerance. What is left is verified on the shingle sets. Links are counted and joined up inside the task, so no row is
made per pair. Equal texts are one text with a count.
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
from larder.llm.textbuf import WORD_BASES, Chunk, Spans, byte_spans, chunks, give_back, mix
from larder.llm.texts import KEY, distinct_texts, text_key
from larder.session import cut_lineage

SHINGLE = 5
THRESHOLD = 0.8
#: 25 bands of 5 values: two texts at the threshold share none with a probability of 5e-5.
BANDS = 25
BAND_ROWS = 5
HASHES = 128
STEP = 16
TOLERANCE = 1e-6
#: Texts, and bytes of them, that one task compares; a larger candidate group is split, and each two slices meet.
SLICE_TEXTS = 1024
SLICE_BYTES = 1 << 23
PAIRS_AT_ONCE = 1 << 17
#: From so many pairs of a group on, and up to so many shingles that its texts share, sets are compared by a matrix product.
DENSE_PAIRS = 1 << 14
DENSE_SHINGLES = 1 << 13
SPARSE = 16


def shingle_sets(chunk: Chunk, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles, and where each text's begin. A text of fewer words than a shingle is one shingle,
    a text without words has none. Shingles that repeat inside a text are listed as often."""
    start, end, first = chunk.words()
    codes = byte_spans(chunk.data).hash(start, end)
    spans = Spans(codes, WORD_BASES[0])
    count = np.diff(first)
    number = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    bounds = np.append(0, np.cumsum(number))
    at = np.arange(int(bounds[-1])) + np.repeat(first[:-1] - bounds[:-1], number)
    return spans.hash(at, at + np.repeat(np.minimum(count, shingle), number)), bounds


def multipliers(hashes: int) -> np.ndarray:
    return np.random.default_rng(hashes).integers(1, 1 << 63, (hashes, 2), dtype=np.uint64) | np.uint64(1)


def min_hashes(shingles: np.ndarray, bounds: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """MinHash values of each text that has shingles; rows of others are all ones."""
    out = np.full((len(bounds) - 1, hashes), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        starts = bounds[full]
        for k, (a, b) in enumerate(multipliers(hashes)):
            out[full, k] = np.minimum.reduceat(((shingles + b) * a >> np.uint64(32)).astype(np.uint32), starts)
    return out


def least_matches(hashes: int = HASHES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For each number of compared values, the fewest matches at which the pair stays.

    With ``m`` of ``n`` values equal and a uniform prior, the similarity's posterior is Beta(m + 1, n - m + 1); it reaches
    the threshold with the probability that a binomial of n + 1 trials has at most ``m`` successes.
    """
    out = np.zeros(hashes + 1, dtype=np.int64)
    for n in range(1, hashes + 1):
        total = 0.0
        for m in range(n + 1):
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                              + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
            if total >= tolerance:
                out[n] = m
                break
    return out


def _band_rows(shingle: int, hashes: int, bands: int, rows: int):
    names = ["band", "value", *KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for chunk in chunks(batch.column(2)):
                shingles, bounds = shingle_sets(chunk, shingle)
                has = np.flatnonzero(np.diff(bounds))
                values = min_hashes(shingles, bounds, hashes)[has]
                keys = np.zeros((len(has), bands), dtype=np.uint64)
                for b in range(bands):
                    for r in range(rows):
                        keys[:, b] = mix(keys[:, b] + values[:, b * rows + r] + np.uint64(1))
                pick = np.repeat(chunk.first + has, bands)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(bands, dtype=np.int32), len(has))), pa.array(keys.ravel().view(np.int64)),
                                                  pa.array(k1[pick]), pa.array(k2[pick])], names)

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In each bucket, links from the first text to the others; a bucket of any size streams through."""
    last = None
    for batch in batches:
        band, value, k1, k2 = (c.to_numpy() for c in batch.columns)
        if not len(band):
            continue
        new = np.append(True, (band[1:] != band[:-1]) | (value[1:] != value[:-1]))
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        h1, h2 = k1[head], k2[head]
        if last is not None and (band[0], value[0]) == last[:2]:
            own = head == 0
            h1[own], h2[own], new[0] = last[2], last[3], False
        last = (band[-1], value[-1], h1[-1], h2[-1])
        keep = ~new & ((k1 != h1) | (k2 != h2))
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (k1, k2, h1, h2)], [*KEY, "h1", "h2"])


class Sets:
    """Shingle sets of a group as numbers of the group's own vocabulary."""

    def __init__(self, shingles: np.ndarray, bounds: np.ndarray):
        doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.vocabulary, ids = np.unique(shingles, return_inverse=True)
        flat = np.unique(doc * len(self.vocabulary) + ids)
        self.ids = flat % max(1, len(self.vocabulary))
        self.bounds = np.searchsorted(flat, np.arange(len(bounds)) * len(self.vocabulary))
        self.sizes = np.diff(self.bounds)
        self.dense: np.ndarray | None = None

    def _shared(self) -> np.ndarray | None:
        """Texts by the shingles that more than one of them has, if these are few enough for a matrix."""
        if self.dense is None:
            often = np.flatnonzero(np.bincount(self.ids, minlength=len(self.vocabulary)) > 1)
            if len(often) > DENSE_SHINGLES:
                return None
            place = np.full(len(self.vocabulary), -1, dtype=np.int64)
            place[often] = np.arange(len(often))
            row, column = np.repeat(np.arange(len(self.sizes)), self.sizes), place[self.ids]
            self.dense = np.zeros((len(self.sizes), len(often)), dtype=np.float32)
            self.dense[row[column >= 0], column[column >= 0]] = 1
        return self.dense

    def similar(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Which pairs reach the threshold; ``x`` is sorted."""
        if len(x) >= DENSE_PAIRS and (dense := self._shared()) is not None:  # many pairs of like texts: whole numbers by product
            rows, at = np.unique(x, return_inverse=True)
            both = (dense[rows] @ dense.T)[at, y].astype(np.int64)
            return both >= threshold * (self.sizes[x] + self.sizes[y] - both) - 1e-9
        both = np.zeros(len(x), dtype=np.int64)
        mark = np.zeros(len(self.vocabulary), dtype=bool)
        cuts = np.append(np.flatnonzero(np.append(True, x[1:] != x[:-1])), len(x))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = self.ids[self.bounds[x[a]] : self.bounds[x[a] + 1]]
            mark[own] = True
            partners = y[a:b]
            size = self.sizes[partners]
            total = np.cumsum(size)
            at = np.arange(int(total[-1])) + np.repeat(self.bounds[partners] - (total - size), size)
            both[a:b] = np.add.reduceat(mark[self.ids[at]].astype(np.int64), total - size)
            mark[own] = False
        return both >= threshold * (self.sizes[x] + self.sizes[y] - both) - 1e-9


def similar_pairs(shingles: np.ndarray, bounds: np.ndarray, slices: np.ndarray | None, threshold: float, hashes: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of texts of one group that reach the threshold; with ``slices``, only pairs of texts of different slices."""
    values = min_hashes(shingles, bounds, hashes)
    n = len(values)
    equal = np.zeros((n, n), dtype=np.uint8)
    alive = np.triu(np.ones((n, n), dtype=bool) if slices is None else slices[:, None] != slices[None, :], 1)
    first = 0
    while first < hashes:  # all pairs at once while many are left, then pair by pair
        stop = min(first + STEP, hashes)
        for k in range(first, stop):
            equal += values[:, k][:, None] == values[:, k][None, :]
        alive &= equal >= least[stop]
        first = stop
        if np.count_nonzero(alive) * SPARSE < n * n:
            break
    x, y = np.nonzero(alive)
    sets, found = None, ([], [])
    for a in range(0, len(x), PAIRS_AT_ONCE):
        px, py = x[a : a + PAIRS_AT_ONCE], y[a : a + PAIRS_AT_ONCE]
        count = equal[px, py].astype(np.int64)
        for k in range(first, hashes, STEP):
            stop = min(k + STEP, hashes)
            count += (values[px, k:stop] == values[py, k:stop]).sum(axis=1)
            stay = count >= least[stop]
            px, py, count = px[stay], py[stay], count[stay]
        if len(px):
            sets = sets or Sets(shingles, bounds)
            ok = sets.similar(px, py, threshold)
            found[0].append(px[ok])
            found[1].append(py[ok])
    return tuple(np.concatenate(f) if f else np.empty(0, np.int64) for f in found)


def _compare(shingle: int, threshold: float, hashes: int, tolerance: float):
    least = least_matches(hashes, threshold, tolerance)
    names = [*KEY, "links", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, ["g1", "g2", "i", "j"]):
            out: list[list] = [[] for _ in range(5)]
            k1, k2, n, salt, i, j = (table.column(k).to_numpy() for k in (*KEY, "copies", "salt", "i", "j"))
            texts = table.column("text").combine_chunks()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                across = i[a] != j[a]  # pairs of one slice are counted where it meets itself, also if the other slice is empty
                if b - a < 2 or (across and (salt[a:b] == salt[a]).all()):
                    continue
                (chunk,) = chunks(texts.slice(a, b - a), 1 << 62)
                shingles, bounds = shingle_sets(chunk, shingle)
                x, y = similar_pairs(shingles, bounds, salt[a:b] if across else None, threshold, hashes, least)
                if not len(x):
                    continue
                own = slice(a, b)
                links = np.zeros(b - a, dtype=np.int64)
                np.add.at(links, x, n[own][y])
                np.add.at(links, y, n[own][x])
                root = roots(b - a, x, y)
                at = np.flatnonzero(links)
                for to, v in zip(out, (k1[own][at], k2[own][at], links[at], k1[own][root[at]], k2[own][root[at]]), strict=True):
                    to.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names)
        give_back()

    return run


def similar_texts(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, hashes: int = HASHES, bands: int = BANDS,
                  band_rows: int = BAND_ROWS, tolerance: float = TOLERANCE, slice_texts: int = SLICE_TEXTS,
                  slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """A row per different text that links with another: ``k1, k2, links`` (copies counted) and ``component``, the least
    text key that its links reach."""
    texts = distinct_texts(docs).select(*KEY, "copies", "text")
    rows = texts.select(*KEY, "text").mapInArrow(_band_rows(shingle, hashes, bands, band_rows), "band int, value long, k1 long, k2 long")
    stars = rows.repartition("band", "value").sortWithinPartitions("band", "value").mapInArrow(_stars, "k1 long, k2 long, h1 long, h2 long")
    stars = stars.select(F.struct(*KEY).alias("x"), F.struct(F.col("h1").alias("k1"), F.col("h2").alias("k2")).alias("y"))
    groups = components(stars, "x", "y").select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"),
                                                F.col("component.k1").alias("g1"), F.col("component.k2").alias("g2"))
    groups = cut_lineage(groups)
    members = texts.join(groups.hint("shuffle_hash"), KEY)
    size = members.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    slices = F.greatest(F.ceil(F.col("n") / slice_texts), F.ceil(F.col("bytes") / slice_bytes), F.lit(1)).cast("int")
    size = size.select("g1", "g2", slices.alias("slices")).where("slices > 1")
    dealt = members.join(size, ["g1", "g2"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.col("slices")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.withColumns({"i": F.least("salt", "other"), "j": F.greatest("salt", "other")}).drop("slices", "other")
    met = dealt.repartition("g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j")
    links = cut_lineage(met.mapInArrow(_compare(shingle, threshold, hashes, tolerance), "k1 long, k2 long, links long, r1 long, r2 long"))
    counts = links.groupBy(*KEY).agg(F.sum("links").alias("links"))
    edges = links.select(F.struct(*KEY).alias("x"), F.struct(F.col("r1").alias("k1"), F.col("r2").alias("k2")).alias("y"))
    parts = components(edges, "x", "y").select(F.col("node.k1").alias("k1"), F.col("node.k2").alias("k2"), "component")
    return counts.join(parts, KEY)


def _classes(docs: DataFrame, **parameters) -> DataFrame:
    """Each different text of at least one word with its links, component and the component's least document."""
    linked = similar_texts(docs, **parameters)
    rows = docs.select("doc_id", *text_key(), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("solid"))
    kinds = rows.where("solid").groupBy(*KEY).agg(F.min("doc_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
    kinds = kinds.join(linked, KEY, "left").withColumn("component", F.coalesce("component", F.struct(*KEY)))
    kinds = cut_lineage(kinds)
    head = kinds.groupBy("component").agg(F.min(F.struct(F.col("owner").isNull().alias("none"), "owner", *KEY)).alias("head"))
    return kinds.join(head, "component").select(
        *KEY, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("head.owner").alias("class_id"),
        ((F.col("head.k1") == F.col("k1")) & (F.col("head.k2") == F.col("k2"))).alias("is_head"))


def jaccard_join(docs: DataFrame, **parameters) -> DataFrame:
    """Links between documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

    A row per row of ``docs``: ``doc_id, class_id`` (least ``doc_id`` that links reach, its own if none), ``n_links`` (other
    rows linked directly, copies counted) and ``kept`` (``doc_id = class_id``). Texts without a word, null ones too, link with
    nothing. Null ids are passed over where there is another. Other columns are ignored.
    """
    kinds = _classes(docs, **parameters).select(*KEY, "n_links", "class_id", F.lit(True).alias("solid"))
    out = docs.select("doc_id", *text_key()).join(kinds, KEY, "left")
    own = F.when(F.col("solid"), F.col("class_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def one_of_each(docs: DataFrame, columns: list[str], **parameters) -> DataFrame:
    """The rows of ``docs`` that are left when one document of each class stays, the one of least id (null last).

    A row that repeats as a whole stays once; texts without a word stay as they are.
    """
    heads = _classes(docs, **parameters).where("is_head").select(*KEY)
    kept = distinct_texts(docs, [c for c in columns if c not in ("doc_id", "text")]).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).join(heads, KEY)
    kept = kept.select(*[F.col("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in columns])
    blank = docs.where(~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))).select(*columns)
    return kept.unionByName(blank)
