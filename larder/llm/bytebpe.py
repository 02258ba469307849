"""Byte-level BPE of whole texts, and back.

A text is cut into matches of the vocabulary's pattern. A match that is an entry of the vocabulary as a whole is found
through a minimal perfect hash of all entries; any other is merged from its bytes: neighbours that may be merged wait in a
heap by rank, and the parts are a linked list over the bytes. Texts are taken unit by unit (``units``), and a worker
remembers the ids of a bounded number of units and of their matches; new units are split as one text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import sys
from collections.abc import Iterator
from functools import cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.perfecthash import PerfectHash
from larder.llm.textbuf import BASES, byte_spans, give_back
from larder.llm.units import Numbers, units

#: Units, and ids of them, that a worker remembers before it starts anew.
UNITS = 1 << 19
UNIT_IDS = 1 << 22
#: Texts that are worked on at once, in characters; a longer text is worked on alone.
BATCH_CHARS = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Entries of a rank file: a base64 string of the bytes and a number on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file) if a}


@cache
def newer_signs() -> str:
    """Signs whose class in ``regex`` is not that of the tokenizer library, whose tables are of another Unicode version.

    The library takes all of them for neither letter nor number; one that it took for either would be refused here.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    out = set()
    for pattern in (r"\p{L}", r"\p{N}", r"\s"):
        found = tiktoken.Encoding("signs", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        theirs = set(found.decode_bytes(found.encode_ordinary(every)).decode())
        ours = set(regex.findall(pattern, every))
        if theirs - ours:
            raise ValueError(f"{len(theirs - ours)} signs of {pattern} that the pattern library does not know")
        out |= ours - theirs
    return "".join(sorted(out))


def merge_bytes(word: bytes, first: list[int], ranks: dict[bytes, int], longest: int) -> list[int]:
    """Ids of a word by merging neighbours, least rank first, the leftmost of equal ones.

    ``first`` has the rank of each two bytes that stand side by side, -1 where there is none.
    """
    n = len(word)
    after, before = list(range(1, n + 2)), list(range(-1, n))  # where the next part begins, and the one before
    now = [*first, -1]  # rank of the part that begins here with the next one, as long as both are parts
    heap = [rank * n + k for k, rank in enumerate(first) if rank >= 0]
    heapq.heapify(heap)
    get, pop, push = ranks.get, heapq.heappop, heapq.heappush
    while heap:
        rank, a = divmod(pop(heap), n)
        if now[a] != rank:
            continue
        b = after[a]
        after[a] = c = after[b]
        now[a] = now[b] = -1  # no part begins at b any more
        if c < n:
            before[c] = a
            d = after[c]
            if d - a <= longest and (rank := get(word[a:d])) is not None:
                now[a] = rank
                push(heap, rank * n + a)
        if a:
            z = before[a]
            if c - z <= longest and (rank := get(word[z:c])) is not None:
                now[z] = rank
                push(heap, rank * n + z)
            else:
                now[z] = -1
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : after[a]]])
        a = after[a]
    return out


class Lists:
    """Lists of ids by number, one after another in one array."""

    def __init__(self):
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.n = self.used = 0

    def add(self, ids: np.ndarray, size: np.ndarray) -> None:
        """Further lists: all their ids, and how many each has."""
        n, used = self.n + len(size), self.used + len(ids)
        if n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * n), np.resize(self.size, 2 * n)
        if used > len(self.ids):
            self.ids = np.resize(self.ids, 2 * used)
        self.ids[self.used : used] = ids
        self.size[self.n : n] = size
        self.start[self.n : n] = self.used + np.cumsum(size) - size
        self.n, self.used = n, used

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some lists, and how many each has."""
        size = self.size[numbers]
        end = np.cumsum(size)
        at = np.arange(int(end[-1]) if len(end) else 0) + np.repeat(self.start[numbers] - (end - size), size)
        return self.ids[at], size


class ByteBpe:
    """Ids of texts under a rank file and a pattern, and the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, newer: str = ""):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        # a character class is fast only within the first 2^16 signs, so a sign beyond them counts as one that may differ
        plain = "".join(c for c in newer if c < "\U00010000")
        self.newer = re.compile(f"[{re.escape(plain)}\U00010000-\U0010FFFF]") if newer else None
        self.stand_in = dict.fromkeys(map(ord, newer), "")  # of private use: neither letter, number nor blank
        entries = list(ranks)
        self.whole = PerfectHash(self._hashes(entries))
        at = self.whole.numbers(self._hashes(entries))
        self.entries: list[bytes] = [b""] * len(entries)
        self.ids = np.zeros(len(entries), dtype=np.int64)
        for k, entry in zip(at.tolist(), entries, strict=True):
            self.entries[k] = entry
        self.ids[at] = np.fromiter(ranks.values(), np.int64, len(ranks))
        self.ids_of = self.ids.tolist()
        self.bytes_of = np.full(int(self.ids.max()) + 1, None, dtype=object)
        self.bytes_of[self.ids] = np.array([*self.entries, None], dtype=object)[:-1]
        self.pairs = np.full(1 << 16, -1, dtype=np.int64)  # rank of each two bytes
        for entry, rank in ranks.items():
            if len(entry) == 2:
                self.pairs[entry[0] << 8 | entry[1]] = rank
        self._forget()

    def _forget(self) -> None:
        self.known, self.unit_ids = Numbers(), Lists()
        self.matches, self.match_ids = Numbers(), Lists()  # every match of a known unit

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size)
        return byte_spans(np.frombuffer(b"".join(words), dtype=np.uint8), BASES[0]).hash(end - size, end)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern, by the library's classes of signs."""
        if self.newer is None or text.isascii() or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.stand_in))]

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches, and how many each has: whole entries through the hash, all others by merging."""
        out = []
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ranks = self.pairs[data[:-1] << 8 | data[1:]].tolist()
        at = 0
        for word, k in zip(words, self.whole.numbers(self._hashes(words)).tolist(), strict=True):
            end = at + len(word)
            if k >= 0 and self.entries[k] == word:
                out.append([self.ids_of[k]])
            else:
                out.append(merge_bytes(word, ranks[at : end - 1], self.ranks, self.longest))
            at = end
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.uint32, int(size.sum())), size

    def _learn(self, fresh: list[str | tuple[str]]) -> None:
        """Ids of units; a unit in a tuple opens its text, all others stand behind a blank.

        Units that neither hold a blank nor end in white space are split as one text: a match begins at every blank before
        them and at no other place in them, so the matches that open with a blank are where the units begin.
        """
        rest = [isinstance(u, tuple) or " " in u or u[-1].isspace() for u in fresh]
        split = [self.split(u[0] if isinstance(u, tuple) else " " + u) for u, r in zip(fresh, rest, strict=True) if r]
        joined = self.split("".join([" " + u for u, r in zip(fresh, rest, strict=True) if not r]))
        before = len(self.matches)
        pieces = list(chain(joined, *split))
        code = np.fromiter(map(self.matches.__getitem__, pieces), np.int64, len(pieces))
        if len(self.matches) > before:
            self.match_ids.add(*self.words([p.encode() for p in islice(self.matches, before, None)]))
        rest = np.array(rest)
        opens = np.fromiter((p[0] == " " for p in joined), bool, len(joined))
        unit = np.concatenate((np.flatnonzero(~rest)[np.cumsum(opens) - 1], np.repeat(np.flatnonzero(rest), list(map(len, split)))))
        order = np.argsort(unit, kind="stable")
        ids, size = self.match_ids.get(code[order])
        self.unit_ids.add(ids, np.bincount(unit[order], weights=size, minlength=len(fresh)).astype(np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's begin (one entry more than there are texts)."""
        if len(self.known) > UNITS or self.unit_ids.used > UNIT_IDS:
            self._forget()
        asked: list[str | tuple[str]] = []
        ends = []
        for text in texts:
            if text:
                own = units(text)
                own[0] = (own[0],)
                asked += own
            ends.append(len(asked))
        before = len(self.known)
        code = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        ids, size = self.unit_ids.get(code)
        return ids, np.append(0, np.cumsum(size))[np.append(0, ends)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids in a row."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.bytes_of):
            raise KeyError("an id that the vocabulary does not have")
        return b"".join(self.bytes_of[ids].tolist())


_made: dict[tuple, ByteBpe] = {}


def byte_bpe(path: str, pattern: str, newer: str) -> ByteBpe:
    """One encoder per worker process, vocabulary and pattern."""
    if (path, pattern) not in _made:
        _made[path, pattern] = ByteBpe(read_ranks(path), pattern, newer)
    return _made[path, pattern]


def batches_of(column: pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """The texts of a column in lists of whole rows, each with its first row; a null text is empty."""
    held, size, first = [], 0, 0
    for k, x in enumerate(column):
        text = x.as_py() or ""
        if held and size + len(text) > limit:
            yield first, held
            held, size, first = [], 0, k
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of each row's whole text; a null or empty text has no ids.

    Rows are independent: repeated rows give repeated rows, a null ``doc_id`` stays null, other columns are ignored.
    """
    newer = newer_signs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, newer)
        for batch in batches:
            for first, texts in batches_of(batch.column(1)):
                ids, bounds = bpe.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)).cast(pa.int64()), lists], ["doc_id", "ids"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``decoded`` (binary) of rows with ``ids``; null ids are none. An id that is not in the vocabulary fails."""
    newer = newer_signs()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, newer)
        for batch in batches:
            out = [bpe.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])
        give_back()

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Each row's number of ids, their SHA-256 as little-endian unsigned 32-bit numbers, and that of the bytes they decode to.

    A row per row of ``docs``; nulls, repeats and other columns as in ``encode_texts``. Encoding and decoding run in one
    task per batch of rows, so no ids are shuffled or stored.
    """
    newer = newer_signs()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern, newer)
        for batch in batches:
            for first, texts in batches_of(batch.column(1)):
                ids, bounds = bpe.encode(texts)
                ids = ids.astype("<u4")
                own = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                columns = [batch.column(0).slice(first, len(texts)).cast(pa.int64()), pa.array(np.diff(bounds)),
                           pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]),
                           pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in own])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
