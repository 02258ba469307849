"""Best-fit packing of token sequences: documents are cut into pieces of at most a sequence, pieces share sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textbuf import chunks, give_back
from larder.llm.tokens import word_ids
from larder.session import cut_lineage

CAPACITY = 4096
END_ID = 1
#: Pieces per shard. A shard wastes at most part of a few sequences, and its pieces are a few MB in one task.
SHARD_PIECES = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, under a segment tree whose nodes tell how many bins are below them."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, step: int) -> None:
        node, counts = room + self.size, self.counts
        while node:
            counts[node] += step
            node >>= 1

    def put(self, room: int, bin_id: int) -> None:
        if room:
            self.bins[room].append(bin_id)
            if len(self.bins[room]) == 1:
                self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room that still holds ``need``: climb to the first subtree on the right with a bin in
        it, then descend to its first leaf."""
        node, counts = need + self.size, self.counts
        while not counts[node]:
            while node & 1:
                node >>= 1
                if not node:
                    return None
            node += 1
            if node & (node - 1) == 0:  # past the last leaf of this level
                return None
        while node < self.size:
            node <<= 1
            if not counts[node]:
                node += 1
        room = node - self.size
        bin_id = self.bins[room].pop()
        if not self.bins[room]:
            self._add(room, -1)
        return room, bin_id


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of each length, longest first; lengths are 1 to ``capacity``."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    open_bins, made = OpenBins(capacity), 0
    for k, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if length == capacity or (found := open_bins.take(length)) is None:
            room, bin_id = capacity, made
            made += 1
        else:
            room, bin_id = found
        bins[k], offsets[k] = bin_id, capacity - room
        open_bins.put(room - length, bin_id)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """Pieces of each row's ids (its whole text's, then ``end_id``); ``with_ids`` adds the ids themselves.

    A null or empty text is the end id alone. Rows are independent, so repeated rows give repeated pieces, and a null
    ``doc_id`` stays null. Only a document of more than ``capacity`` ids is cut. Other columns are ignored.
    """
    schema = PIECES + (", ids array<long>" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_ids(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0)
            for chunk in chunks(batch.column(1)):
                ids, bounds = table.chunk(chunk)
                rows, piece, start, length, crc, own = [], [], [], [], [], []
                for k in range(len(chunk)):
                    whole = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, a in enumerate(range(0, len(whole), capacity)):
                        part = whole[a : a + capacity]
                        rows.append(chunk.first + k)
                        piece.append(p)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            own.append(part.astype(np.int64))
                columns = [doc_ids.take(pa.array(rows)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                           pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(own, pa.list_(pa.int64()))] if with_ids else []), names)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of 1 to ``capacity``.

    Pieces are dealt evenly over shards, whose number follows the count of pieces; each shard is packed by best-fit
    decreasing. Ties of length go by ``doc_id`` (null first) and ``piece``, so the result does not depend on how rows
    arrive.
    """
    pieces = cut_lineage(pieces)
    shards = max(1, -(-pieces.count() // shard_pieces))
    names = pieces.columns
    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes) + ", sequence_id long, offset long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        ids, length = rows.column("doc_id"), rows.column("length").to_numpy()
        known, ids = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        order = np.lexsort((rows.column("ids_crc32").to_numpy(), rows.column("piece").to_numpy(), ids, known, -length))
        bins, offsets = best_fit_decreasing(length[order], capacity)
        rows = rows.select(names).take(pa.array(order))
        return rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins)).append_column("offset", pa.array(offsets))

    # hash() deals the shards out; a second hash, because the exchange hashes the shard itself
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    return pieces.withColumn("shard_", shard).groupBy("shard_").applyInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Each piece of every document with the sequence it is in and its place there. An empty table gives no rows."""
    return pack(token_pieces(docs, tokenizer_path, capacity, with_ids=with_ids), capacity, shard_pieces)
