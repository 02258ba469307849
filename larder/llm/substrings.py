"""Substring dedup on windows of words, behind a count-min sketch.

A window of words is looked at through one short gram inside it, the one of least hash: equal windows have the same one
at the same place, so a window can only repeat if its gram does, and there are far fewer grams than windows. Each
partition sketches its grams' counts; merged, the sketch never counts too low. A second pass groups exactly the windows
whose gram it estimates to be repeated, by 128 bits of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textbuf import WORD_BASES, Chunk, Spans, byte_spans, chunks, mix, window_min
from larder.llm.texts import KEY, distinct_texts, text_key

WINDOW = 13
GRAM = 6
DEPTH = 2
#: Cells of a sketch row for each gram that the corpus is expected to have, and bytes of text for each gram.
CELLS_PER_GRAM = 4
BYTES_PER_GRAM = 24
MIN_BITS = 16
#: At most 2^28 cells a row: two rows of one bit a cell are 64 MB, the most that is ever broadcast. A larger corpus keeps
#: this size; more windows then pass on to the exact grouping, which loses none either way.
MAX_BITS = 28
CHUNK_BITS = 20
#: Windows that a task holds before it deals them out, and windows that a task of the exact grouping is to get.
HOLD = 1 << 19
BUCKET_WINDOWS = 1 << 19
LAST = np.iinfo(np.int64).max


class Windows:
    """Windows of a chunk's texts, by the number of their first word in the chunk."""

    def __init__(self, chunk: Chunk, window: int):
        self.start, self.end, self.first = chunk.words()
        self.codes = byte_spans(chunk.data).hash(self.start, self.end)
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(chunk)), counts)
        self.window = window
        self.at = np.flatnonzero(self.doc[: -window + 1 or None] == self.doc[window - 1 :]) if len(self.doc) >= window else np.empty(0, np.int64)

    def hashes(self, k: int = 0) -> np.ndarray:
        """Of every window, valid or not."""
        return Spans(self.codes, WORD_BASES[k]).every(self.window)

    def grams(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each gram, and for each valid window the place of the one it is looked at through."""
        h = Spans(self.codes, WORD_BASES[0]).every(gram)
        if not len(self.at):
            return h, np.empty(0, np.int64)
        # the last of the least ones: the order of places inside a window is that of its words alone
        place = np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)
        least = window_min((h & np.uint64(0xFFFFFFFF00000000)) | place, self.window - gram + 1)
        return h, (np.uint64(0xFFFFFFFF) - (least[self.at] & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _cells(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    return [(mix(hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(d + 1)) >> np.uint64(64 - bits)).astype(np.uint32) for d in range(DEPTH)]


def _partial(bits: int, window: int, gram: int):
    """Sketch of a partition: the cells hit, a cell at most twice, in parts of 2^CHUNK_BITS cells."""
    part_bits = min(bits, CHUNK_BITS)

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for depth, cells in enumerate(held):
            cells = np.sort(np.concatenate(cells))
            third = np.zeros(len(cells), dtype=bool)
            third[2:] = cells[2:] == cells[:-2]
            cells = cells[~third]
            parts = cells >> np.uint32(part_bits)
            cuts = np.append(np.flatnonzero(np.append(True, parts[1:] != parts[:-1])), len(cells))
            low = (cells & np.uint32((1 << part_bits) - 1)).astype("<u4")
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(cuts) - 1, depth), pa.int32()), pa.array(parts[cuts[:-1]].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["depth", "part", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
        n = 0
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                h, through = Windows(chunk, window).grams(gram)
                if not len(through):
                    continue
                used = h[through[np.append(True, through[1:] != through[:-1])]]
                for rows, cells in zip(held, _cells(used, bits), strict=True):
                    rows.append(cells)
                n += len(used)
                if n >= HOLD:
                    yield from flush(held)
                    held, n = [[] for _ in range(DEPTH)], 0
        if n:
            yield from flush(held)

    return run


def repeat_sketch(docs: DataFrame, bits: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each row of the merged count-min sketch, a bit per cell: whether its count is two or more."""
    part_bits = min(bits, CHUNK_BITS)

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << part_bits, dtype=np.uint8)
        for x in rows["cells"]:
            cells = np.frombuffer(x, dtype="<u4")
            again = cells[1:][cells[1:] == cells[:-1]]  # sorted, a cell at most twice
            counts[cells] = np.minimum(counts[cells] + np.uint8(1), 2)
            counts[again] = 2
        return pd.DataFrame({"depth": [key[0]], "part": [key[1]], "bits": [np.packbits(counts >= 2, bitorder="little").tobytes()]})

    parts = docs.select("text").mapInArrow(_partial(bits, window, gram), "depth int, part int, cells binary")
    merged = parts.groupBy("depth", "part").applyInPandas(merge, "depth int, part int, bits binary")
    out = np.zeros((DEPTH, 1 << (bits - 3)), dtype=np.uint8)
    size = 1 << (part_bits - 3)
    for r in merged.toLocalIterator():
        out[r["depth"], r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _deal(sketch, bits: int, buckets: int, window: int, gram: int):
    """Candidate windows of a partition of distinct texts, dealt out by gram; each window once for each text of its least owner.

    Windows that are looked at through one gram go together, so a text sends and gets a row for many of them.

    A window whose words also start, in this partition, in a smaller document is a finished mark and passes through.
    """

    def flush(held: list[tuple], docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2 = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        doc, gram_hash = (np.concatenate([x[k] for x in held]) for k in (2, 3))
        owner, k1, k2 = (np.concatenate([x[k] for x in docs]) for k in range(3))
        order = np.lexsort((doc, owner[doc], h2, h1))
        h1, h2, doc, gram_hash = h1[order], h2[order], doc[order], gram_hash[order]
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        least = owner[doc][new][np.cumsum(new) - 1]
        late = owner[doc] > least
        # texts of the least owner (one id, or null ids) all go on: a smaller document may be in another partition
        send = ~late & (new | np.append(True, doc[1:] != doc[:-1]))
        yield from _rows(0, h1[send], h2[send], doc[send], owner, k1, k2, (gram_hash[send] >> np.uint64(40)).astype(np.int64) % buckets)
        if late.any():
            yield from _rows(1, h1[late], h2[late][:0], doc[late], owner, k1, k2, doc[late] % buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sketch.value
        held, docs, n, seen = [], [], 0, 0
        for batch in batches:
            owner = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            k1, k2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for chunk in chunks(batch.column(3)):
                w = Windows(chunk, window)
                h, through = w.grams(gram)
                if not len(through):
                    continue
                likely = np.ones(len(h), dtype=bool)
                for row, cells in zip(rows, _cells(h, bits), strict=True):
                    likely &= (row[cells >> np.uint32(3)] >> (cells & np.uint32(7)).astype(np.uint8) & np.uint8(1)).astype(bool)
                at = w.at[likely[through]]
                if not len(at):
                    continue
                held.append((w.hashes(0)[at], w.hashes(1)[at], w.doc[at] + seen, h[through[likely[through]]]))
                here = slice(chunk.first, chunk.first + len(chunk))
                docs.append((owner[here], k1[here], k2[here]))
                seen += len(chunk)
                n += len(at)
                if n >= HOLD:
                    yield from flush(held, docs)
                    held, docs, n, seen = [], [], 0, 0
        if n:
            yield from flush(held, docs)

    return run


def _rows(kind: int, h1, h2, doc, owner, k1, k2, bucket) -> Iterator[pa.RecordBatch]:
    """A row per bucket: hashes, the documents they are in, and for each hash which of these it is."""
    order = np.lexsort((doc, bucket))
    h1, doc, bucket = h1[order], doc[order], bucket[order]
    h2 = h2[order] if len(h2) else h2
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    out: list[list] = [[] for _ in range(6)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, index = np.unique(doc[a:b], return_inverse=True)
        for x, y in zip(out, (h1[a:b], h2[a:b], index.astype("<u4"), owner[own], k1[own], k2[own]), strict=True):
            x.append(y.tobytes())
    names = ["bucket", "kind", "h1", "h2", "doc", "owner", "k1", "k2"]
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(np.full(len(cuts) - 1, kind, np.int32))] + [pa.array(x, pa.binary()) for x in out], names)


DEALT = "bucket int, kind int, h1 binary, h2 binary, doc binary, owner binary, k1 binary, k2 binary"


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of each document: hashes of its windows that also start in a smaller document."""
    h1, h2, owner, k1, k2 = [], [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            x = {k: np.frombuffer(r[k], dtype="<u4" if k == "doc" else np.int64 if k == "owner" else np.uint64 if k[0] == "h" else np.int64)
                 for k in ("h1", "h2", "doc", "owner", "k1", "k2")}
            if r["kind"]:
                yield from _marks(x["h1"], x["k1"][x["doc"]], x["k2"][x["doc"]])
            else:
                h1.append(x["h1"])
                h2.append(x["h2"])
                for to, k in ((owner, "owner"), (k1, "k1"), (k2, "k2")):
                    to.append(x[k][x["doc"]])
    if h1:
        a, b, o = np.concatenate(h1), np.concatenate(h2), np.concatenate(owner)
        order = np.lexsort((o, b, a))
        a, b, o = a[order], b[order], o[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        late = o > o[new][np.cumsum(new) - 1]
        yield from _marks(a[late], np.concatenate(k1)[order][late], np.concatenate(k2)[order][late])


def _marks(h, k1, k2) -> Iterator[pa.RecordBatch]:
    if not len(h):
        return
    order = np.lexsort((k2, k1))
    h, k1, k2 = h[order], k1[order], k2[order]
    cuts = np.append(np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))), len(h))
    yield pa.RecordBatch.from_arrays([pa.array(k1[cuts[:-1]]), pa.array(k2[cuts[:-1]]), pa.array(
        [h[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], [*KEY, "marks"])


def kept_words(chunk: Chunk, w: Windows, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's kept words, each followed by a space, and where each text's begin."""
    keep = ~gone
    size = np.where(keep, w.end - w.start + 1, 0)
    total = np.cumsum(size)
    spread = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(w.start - (total - size), size)
    data = np.append(chunk.data, np.uint8(32))[np.minimum(spread, len(chunk.data))]
    data[total[keep] - 1] = 32
    return data, np.append(0, total)[w.first]


def _apply(window: int, with_text: bool):
    names = [*KEY, "owner", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(4)
            for chunk in chunks(batch.column(3)):
                w = Windows(chunk, window)
                gone = np.zeros(len(w.start) + 1, dtype=np.int64)
                h = None
                for k in range(len(chunk)):
                    if (own := marks[chunk.first + k]).is_valid:
                        h = w.hashes() if h is None else h
                        a, b = w.first[k], w.first[k + 1] - window + 1
                        hit = a + np.flatnonzero(np.isin(h[a:b], np.frombuffer(b"".join(own.as_py()), dtype=np.uint64)))
                        gone[hit] += 1
                        gone[hit + window] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                data, bounds = kept_words(chunk, w, gone)
                raw = memoryview(data)
                removed = np.append(0, np.cumsum(gone))[w.first]
                texts = [bytes(raw[a : max(a, b - 1)]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                here = batch.slice(chunk.first, len(chunk))
                columns = [here.column(0), here.column(1), here.column(2), pa.array(np.diff(w.first)), pa.array(np.diff(removed)),
                           pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([t.decode() for t in texts])] * with_text, names)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, sketch_bits: int | None = None,
                     bucket_windows: int = BUCKET_WINDOWS, with_text: bool = False) -> DataFrame:
    """Remove each word that lies in a window whose words also start in a document with a smaller ``doc_id``.

    Returns a row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``). A null text has no
    words. A null ``doc_id`` counts as larger than all others; rows with equal ids are one document. Texts of fewer words
    than a window keep them. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if sketch_bits is None:
        sketch_bits = min(MAX_BITS, max(MIN_BITS, int(CELLS_PER_GRAM * size / BYTES_PER_GRAM).bit_length()))
    sketch = spark.sparkContext.broadcast(repeat_sketch(docs, sketch_bits, window, gram))
    buckets = max(1, size // (16 * bucket_windows))
    texts = distinct_texts(docs)
    dealt = texts.select("owner", *KEY, "text").mapInArrow(_deal(sketch, sketch_bits, buckets, window, gram), DEALT)
    marks = dealt.repartition(buckets, "bucket").mapInArrow(_group, "k1 long, k2 long, marks binary")
    marks = marks.groupBy(*KEY).agg(F.collect_list("marks").alias("marks"))  # at most a hash per window of the text
    joined = texts.select("owner", *KEY, "text").join(marks.hint("shuffle_hash"), KEY, "left")
    schema = "k1 long, k2 long, owner long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    done = joined.select(*KEY, "owner", "text", "marks").mapInArrow(_apply(window, with_text), schema)
    # what a copy with a larger id has left: nothing, if there is a window at all
    copy = (F.col("n_words") >= window) & F.col("owner").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("owner")))
    out = docs.select("doc_id", *text_key()).join(done, KEY)
    columns = ["doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
               F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("kept_sha256")).alias("kept_sha256")]
    return out.select(*columns, *([F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] * with_text))
