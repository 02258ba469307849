"""Alignment of two tokenizers over a corpus: which ids of the one lie over which of the other, and in how many documents.

A text's tokens under both vocabularies are cut into groups where both end at the same byte. A group links each of its
first ids with each of its second ones. Texts are aligned unit by unit (``units``): both vocabularies end a token before a
unit, so a unit's groups are its own, and a worker remembers those of a bounded number of units.

Counting goes in two passes over the texts. The first one sends, per task and shard of pairs, the different pairs met and
in how many documents; per shard these give a minimal perfect hash of all pairs, and then dense count vectors that it
indexes, added up as a tree. The second pass aligns the texts again and looks its pairs up, each verified by its key.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.bytebpe import batches_of
from larder.llm.perfecthash import KeyedCounts, PerfectHash
from larder.llm.textbuf import give_back, mix
from larder.llm.units import Numbers, units
from larder.session import cut_lineage

#: Shards of pairs. There are at most as many pairs as the product of both vocabularies, so a shard has a bound of its own.
SHARDS = 64
#: Different pairs of some documents that a task holds before it sends them.
HOLD = 1 << 21
#: Tasks that add up one shard's vectors before the last one does.
FAN = 8
#: Bytes of looked-up tables that are broadcast at once; more tables take further rounds over the texts.
ROUND_BYTES = 1 << 26
ENTRY_BYTES = 17
UNITS = 3 << 18
UNIT_LINKS = 1 << 22
UNIT_BYTES = 1 << 25
UNITS_AT_ONCE = 1 << 12
#: Units that go to the first vocabulary's tokenizer as one text.
JOINED = 32
BLOCK_LINKS = 1 << 22
#: An id, a separator and a digit for every power of ten that an id may have.
_WIDTH = 11


class TwoVocabularies:
    """Ids of units under a byte-level vocabulary (first) and a piece vocabulary (second), and their common groups."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        from larder.llm.tokens import _byte_letters

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = {c: bytes([k]) for k, c in enumerate(_byte_letters())}
        self.a_bytes = [b""] * self.a.get_vocab_size(True)
        for entry, k in self.a.get_vocab(False).items():
            self.a_bytes[k] = b"".join(byte.get(c, c.encode()) for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece holds a blank behind another sign, so texts can't be cut at blanks")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        # ids of the second vocabulary beyond the largest one are never met, so this is one number per pair
        self.width = len(pieces)
        n = max(len(self.a_bytes), self.width)
        self.digits = np.zeros((n, _WIDTH), dtype=np.uint8)
        self.n_digits = np.zeros(n, dtype=np.int64)
        for k in range(n):
            own = str(k).encode()
            self.digits[k, : len(own)] = np.frombuffer(own, dtype=np.uint8)
            self.n_digits[k] = len(own)
        self.writes = True
        self._forget()

    def write(self, groups: bool) -> None:
        """Whether groups are written out from now on; units that were met before are forgotten if that changes."""
        if groups != self.writes:
            self._forget()
        self.writes = groups

    def _forget(self) -> None:
        self.known = Numbers()
        self.groups: list[bytes] = []
        #: For each unit: ids of both, groups, links, whether its bytes agree, where its pairs begin, how many they are.
        self.sizes = np.zeros((7, 1 << 12), dtype=np.int64)
        #: Different pairs of each unit, and how often each is linked.
        self.keys, self.links, self.held = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.written = 0
        self.uses = np.zeros(1 << 12, dtype=np.int64)

    def _thin_out(self) -> None:
        """Forgets units that were met once; all of them, if that leaves more than half."""
        names = list(self.known)
        keep = np.flatnonzero(self.uses[: len(names)] > 1)
        keys, links, size = self.linked(keep)
        sizes, groups = self.sizes[:, keep].copy(), [self.groups[k] for k in keep.tolist()]
        self._forget()
        if 2 * len(keep) > UNITS or 2 * len(keys) > UNIT_LINKS or 2 * sum(map(len, groups)) > UNIT_BYTES:
            return
        sizes[5] = np.cumsum(size) - size
        self.known = Numbers((names[k], n) for n, k in enumerate(keep.tolist()))
        self._keep(sizes, keys, links, groups)

    def over(self) -> bool:
        return len(self.known) > UNITS or self.held > UNIT_LINKS or self.written > UNIT_BYTES

    def _keep(self, sizes: np.ndarray, keys: np.ndarray, links: np.ndarray, groups: list[bytes]) -> None:
        n, more = len(self.groups), sizes.shape[1]
        if n + more > self.sizes.shape[1]:
            self.uses = np.append(self.uses, np.zeros(max(more, n), dtype=np.int64))
            self.sizes = np.concatenate((self.sizes, np.zeros((7, max(more, n)), dtype=np.int64)), axis=1)
        if self.held + len(keys) > len(self.keys):
            room = np.zeros(max(len(self.keys), len(keys)), dtype=np.int64)
            self.keys, self.links = np.concatenate((self.keys, room)), np.concatenate((self.links, room))
        sizes[5] += self.held
        self.sizes[:, n : n + more] = sizes
        self.keys[self.held : self.held + len(keys)] = keys
        self.links[self.held : self.held + len(keys)] = links
        self.held += len(keys)
        self.groups += groups
        self.written += sum(map(len, groups))

    def _first_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts under the first vocabulary, and how many each has."""
        found = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(n.sum())), n

    def _first_of_units(self, fresh: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of units under the first vocabulary, and how many each has.

        Units without white space at an edge or a blank inside go to the tokenizer ``JOINED`` at a time, as they stand in a
        text; where a token then does not end with each unit, all go one by one. ``size``: each unit's bytes and its blank's.
        """
        alone = np.array([" " in u or not u or u[0].isspace() or u[-1].isspace() for u in fresh])
        row = [" " + u for u, x in zip(fresh, alone, strict=True) if not x]
        ids, _ = self._first_ids(["".join(row[k : k + JOINED]) for k in range(0, len(row), JOINED)])
        end, stop = np.cumsum(self.a_size[ids]), np.cumsum(size[~alone])
        if len(stop) and not (len(end) and end[-1] == stop[-1] and (end[np.searchsorted(end, stop)] == stop).all()):
            return self._first_ids([" " + u for u in fresh])
        n = np.zeros(len(fresh), dtype=np.int64)
        n[~alone] = np.bincount(np.searchsorted(stop, end), minlength=len(stop))
        if not alone.any():
            return ids, n
        other, n[alone] = self._first_ids([" " + u for u, x in zip(fresh, alone, strict=True) if x])
        out, of_alone = np.empty(len(ids) + len(other), dtype=np.int64), np.repeat(alone, n)
        out[of_alone], out[~of_alone] = other, ids
        return out, n

    def _learn(self, fresh: list[str]) -> None:
        """Aligns units: their tokens under both vocabularies in a row, cut where both end at the same byte."""
        raw = [b" " + u.encode() for u in fresh]
        size, whole = np.fromiter(map(len, raw), np.int64, len(raw)), b"".join(raw)
        join = lambda table, ids: b"".join(map(table.__getitem__, ids))
        ids_a, n_a = self._first_of_units(fresh, size)
        if join(self.a_bytes, ids_a.tolist()) != whole:
            ids_a, n_a = self._first_ids([" " + u for u in fresh])
        found_b = self.b.encode(fresh, num_threads=1)
        n_b = np.fromiter(map(len, found_b), np.int64, len(fresh))
        ids_b = np.fromiter(chain.from_iterable(found_b), np.int64, int(n_b.sum()))
        good = np.ones(len(fresh), dtype=bool)
        unit_a, unit_b = np.repeat(np.arange(len(fresh)), n_a), np.repeat(np.arange(len(fresh)), n_b)
        same = [(np.bincount(u, weights=w[ids], minlength=len(fresh)) == size).all() and join(table, ids.tolist()) == whole
                for u, w, ids, table in ((unit_a, self.a_size, ids_a, self.a_bytes), (unit_b, self.b_size, ids_b, self.b_bytes))]
        if not all(same):
            found_a = [x.tolist() for x in np.split(ids_a, np.cumsum(n_a)[:-1])]
            good = np.array([join(self.a_bytes, a) == r == join(self.b_bytes, b) for a, b, r in zip(found_a, found_b, raw, strict=True)])
            ids_a, ids_b = ids_a[good[unit_a]], ids_b[good[unit_b]]
            unit_a, n_a, n_b = unit_a[good[unit_a]], n_a * good, n_b * good
        end_a, end_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        both = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, end_a), np.searchsorted(both, end_b)
        of_group = np.zeros(len(both), dtype=np.int64)
        of_group[group_a] = unit_a
        each_b = np.bincount(group_b, minlength=len(both))
        start_b, each = np.cumsum(each_b) - each_b, each_b[group_a]
        n_links = np.bincount(unit_a, weights=each, minlength=len(fresh)).astype(np.int64)
        most = len(self.a_bytes) * self.width
        parts, at, upto = [], 0, np.append(0, np.cumsum(each))
        while at < len(ids_a):  # some of the first ids at a time, so that long groups need no more memory than short ones
            stop = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK_LINKS, side="right")) - 1)
            own = each[at:stop]
            total = np.cumsum(own)
            place = np.arange(int(total[-1])) + np.repeat(start_b[group_a[at:stop]] - (total - own), own)
            flat = np.repeat(unit_a[at:stop] * most + ids_a[at:stop] * self.width, own) + ids_b[place]
            parts.append(_sums([(flat, np.ones(len(flat), dtype=np.int64))]))
            at = stop
        keys, links = _sums(parts) if parts else (np.empty(0, np.int64),) * 2
        size = np.bincount(keys // most, minlength=len(fresh))
        n_groups = np.bincount(of_group, minlength=len(fresh))
        sizes = np.stack((n_a, n_b, n_groups, n_links, good, np.cumsum(size) - size, size))
        written = self._written(ids_a, ids_b, group_a, group_b, of_group, len(fresh)) if self.writes else [b""] * len(fresh)
        self._keep(sizes, keys % most, links, written)

    def _written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, of_group: np.ndarray, n: int) -> list[bytes]:
        """Each unit's groups as ``a1,a2|b1;a3|b2;``."""
        ids, group = np.concatenate((a, b)), np.concatenate((group_a, group_b))
        side = np.repeat((0, 1), (len(a), len(b)))
        order = np.lexsort((side, group))
        ids, group, side = ids[order], group[order], side[order]
        last = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
        sign = np.where(last, np.where(side == 0, ord("|"), ord(";")), ord(",")).astype(np.uint8)
        out, size = self.digits[ids], self.n_digits[ids]
        out[np.arange(len(ids)), size] = sign
        flat = out[np.arange(_WIDTH)[None, :] <= size[:, None]].tobytes()
        end = np.cumsum(np.bincount(of_group[group], weights=size + 1, minlength=n).astype(np.int64)).tolist()
        return [flat[x:y] for x, y in zip([0, *end[:-1]], end, strict=True)]

    def linked(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of some units one after another, how often each is linked, and how many each unit has."""
        start, size = self.sizes[5][code], self.sizes[6][code]
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(start - (total - size), size)
        return self.keys[at], self.links[at], size

    def read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of some texts, and where each text's begin (one entry more); an empty text has none."""
        if self.over():
            self._thin_out()
        asked: list[str] = []
        bounds = [0]
        for text in texts:
            if text:
                asked += units(text)
            bounds.append(len(asked))
        before = len(self.known)
        code = np.fromiter(map(self.known.__getitem__, asked), np.int64, len(asked))
        fresh = list(islice(self.known, before, None)) if len(self.known) > before else []
        for k in range(0, len(fresh), UNITS_AT_ONCE):
            self._learn(fresh[k : k + UNITS_AT_ONCE])
        self.uses[: len(self.known)] += np.bincount(code, minlength=len(self.known))
        return code, np.array(bounds)

    def clean(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which texts have tokens: some units, and all of them agree with their bytes."""
        good = np.append(0, np.cumsum(1 - self.sizes[4][code]))
        return (good[bounds[1:]] == good[bounds[:-1]]) & (bounds[1:] > bounds[:-1])


_made: dict[tuple[str, str], TwoVocabularies] = {}


def vocabularies(first: str, second: str) -> TwoVocabularies:
    """One table of units per worker process and pair of vocabularies."""
    if (first, second) not in _made:
        _made[first, second] = TwoVocabularies(first, second)
    return _made[first, second]


def _drop_units() -> None:
    """Forgets the units of this worker process, in tasks that align no texts and hold tables of pairs instead."""
    for both in _made.values():
        both._forget()


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers, sorted or small, in few bytes."""
    return zlib.compress(np.diff(x, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(x), dtype="<i8"))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) + np.uint64(7)) % np.uint64(shards)).astype(np.int64)


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by key, keys ascending."""
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, weights=np.concatenate([n for _, n in parts]), minlength=len(keys)).astype(np.int64)


def _count_pairs(first: str, second: str, shards: int, fan: int, hold: int):
    """Pairs that a task has met and in how many documents, per shard; ``branch`` deals them to the branches of the tree."""
    names = ["shard", "branch", "keys", "counts"]

    def send(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys, counts = _sums(parts)
        shard = _shard(keys, shards)
        rows: list[tuple] = []
        branch = int(mix(np.array([keys.sum(), len(keys)], dtype=np.uint64).cumsum())[1] % np.uint64(fan))
        for s in np.unique(shard).tolist():
            own = shard == s
            rows.append((s, branch, _packed(keys[own]), _packed(counts[own])))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(first, second)
        both.write(False)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0
        for batch in batches:
            for _, texts in batches_of(batch.column(0)):
                code, bounds = both.read(texts)
                clean = both.clean(code, bounds)
                doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
                keep = clean[doc]
                code, doc = code[keep], doc[keep]
                if not len(code):
                    continue
                most = len(both.known)
                flat = np.unique(doc * most + code)  # a document's different units
                doc, code = flat // most, flat % most
                keys, _, size = both.linked(code)
                own, keys = np.unique(keys, return_inverse=True)
                doc = np.unique(keys * len(texts) + np.repeat(doc, size)) // len(texts)  # a document's different pairs
                parts.append((own, np.bincount(doc, minlength=len(own))))
                n += len(own)
                if n > hold:
                    parts = [_sums(parts)]
                    n = len(parts[0][0])
                    if 2 * n > hold:
                        yield send(parts)
                        parts, n = [], 0
        if n:
            yield send(parts)
        give_back()

    return run


def _rows_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Rows of sorted batches as (key columns, the other columns)."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = [c[k].as_py() for c in batch.columns]
            yield tuple(row[:keys]), row[keys:]


def _unite(last: bool):
    """Different keys of each shard and branch, streamed; the ``last`` step of the tree makes the shard's perfect hash."""
    names = ["shard", "keys"] if not last else ["shard", "keys", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_units()
        now, held, fresh, n = None, np.empty(0, np.int64), [], 0

        def out() -> pa.RecordBatch:
            keys = np.unique(np.concatenate([held, *fresh]))
            columns = [pa.array([now[0]], pa.int32())]
            if last:
                made = PerfectHash(keys)
                ordered = np.empty(len(keys), dtype=np.int64)
                ordered[made.numbers(keys)] = keys
                columns += [pa.array([ordered.tobytes()], pa.binary()), pa.array([pickle.dumps(made)], pa.binary())]
            else:
                columns.append(pa.array([_packed(keys)], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names)

        for key, (packed,) in _rows_of(batches, 1 if last else 2):
            if key != now:
                if now is not None:
                    yield out()
                now, held, fresh, n = key, np.empty(0, np.int64), [], 0
            fresh.append(_unpacked(packed))
            n += len(fresh[-1])
            if n > max(len(held), 1 << 16):
                held, fresh, n = np.unique(np.concatenate([held, *fresh])), [], 0
        if now is not None:
            yield out()
        give_back()

    return run


def _table(keys: bytes, made: bytes, counts: np.ndarray | None = None) -> KeyedCounts:
    out = object.__new__(KeyedCounts)
    out.hash, out.keys = pickle.loads(made), np.frombuffer(keys, dtype=np.int64)
    out.counts = np.zeros(len(out.keys), dtype=np.int64) if counts is None else counts
    return out


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's dense vector of one branch; a branch's first row is the shard's hash, its others are tasks' counts."""
    _drop_units()
    now, table = None, None
    out = lambda: pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([zlib.compress(table.counts.tobytes(), 1)], pa.binary())],
                                             ["shard", "counts"])
    for (shard, branch, kind), (keys, counts, made) in _rows_of(batches, 3):
        if kind == 0:
            if table is not None:
                yield out()
            now, table = (shard, branch), _table(keys, made)
        else:
            table.add(_unpacked(keys), _unpacked(counts))
    if table is not None:
        yield out()
    give_back()


def _sum_branches(width: int):
    """Each shard's whole counts, in the order of its hash, and each first id's highest count in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_units()
        now, keys, made, total = None, b"", b"", None

        def out() -> pa.RecordBatch:
            first = np.frombuffer(keys, dtype=np.int64) // width
            ids, back = np.unique(first, return_inverse=True)
            best = np.zeros(len(ids), dtype=np.int64)
            np.maximum.at(best, back, total)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([len(first)], pa.int64()), pa.array([keys], pa.binary()), pa.array([made], pa.binary()),
                 pa.array([total.tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([best], pa.list_(pa.int64()))],
                ["shard", "n", "keys", "hash", "counts", "ids", "best"])

        for (shard, kind), (own_keys, counts, own_hash) in _rows_of(batches, 2):
            if kind == 0:
                if now is not None:
                    yield out()
                now, keys, made, total = shard, own_keys, own_hash, np.zeros(len(own_keys) // 8, dtype=np.int64)
            else:
                total += np.frombuffer(zlib.decompress(counts), dtype=np.int64)
        if now is not None:
            yield out()
        give_back()

    return run


def pair_tables(docs: DataFrame, first: str, second: str, shards: int = SHARDS, fan: int = FAN, hold: int = HOLD) -> DataFrame:
    """A row per shard of linked pairs: its keys (first id times the second vocabulary's size, plus second id) in the order of
    its perfect hash, the hash, in how many rows of ``docs`` each pair is linked, and each first id's highest such count."""
    width = vocabularies(first, second).width
    spec = "shard int, branch int, keys binary, counts binary"
    parts = cut_lineage(docs.select("text").mapInArrow(_count_pairs(first, second, shards, fan, hold), spec))
    united = parts.select("shard", "branch", "keys").repartition("shard", "branch").sortWithinPartitions("shard", "branch")
    united = united.mapInArrow(_unite(False), "shard int, keys binary")
    hashes = united.repartition("shard").sortWithinPartitions("shard").mapInArrow(_unite(True), "shard int, keys binary, hash binary")
    hashes = cut_lineage(hashes)
    none = F.lit(None).cast("binary")
    heads = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(fan - 1))).alias("branch"), F.lit(0).alias("kind"), "keys", none.alias("counts"), "hash")
    tasks = parts.select("shard", "branch", F.lit(1).alias("kind"), "keys", "counts", none.alias("hash"))
    vectors = heads.unionByName(tasks).repartition("shard", "branch").sortWithinPartitions("shard", "branch", "kind")
    vectors = vectors.mapInArrow(_add_up, "shard int, counts binary")
    vectors = vectors.select("shard", F.lit(1).alias("kind"), none.alias("keys"), "counts", none.alias("hash"))
    both = hashes.select("shard", F.lit(0).alias("kind"), "keys", none.alias("counts"), "hash").unionByName(vectors)
    both = both.repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(_sum_branches(width), "shard int, n long, keys binary, hash binary, counts binary, ids array<long>, best array<long>")


SUMS = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _look_up(first: str, second: str, tables, best, shards: int, last: bool):
    """Sums over each row's links; pairs of shards that ``tables`` lacks count nothing here."""
    names = ["doc_id", *([] if last else ["text"]), *(x.split()[0] for x in SUMS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(first, second)
        both.write(True)
        held = {s: _table(keys, made, np.frombuffer(counts, dtype=np.int64)) for s, keys, made, counts in tables.value}
        highest = best.value
        for batch in batches:
            for start, texts in batches_of(batch.column(1)):
                code, bounds = both.read(texts)
                clean = both.clean(code, bounds)
                own, back = np.unique(code, return_inverse=True)
                sums = np.zeros((6, len(own) + 1), dtype=np.int64)
                if len(own):
                    sums[:4, :-1] = both.sizes[:4][:, own]
                    keys, links, size = both.linked(own)
                    unit = np.repeat(np.arange(len(own)), size)
                    keys, place = np.unique(keys, return_inverse=True)
                    shard, count = _shard(keys, shards), np.zeros(len(keys), dtype=np.int64)
                    for s in np.unique(shard).tolist():
                        if s in held:
                            count[shard == s] = held[s].get(keys[shard == s])
                    top = (count > 0) & (count == highest[keys // both.width])
                    np.add.at(sums[4], unit, links * top[place])
                    np.add.at(sums[5], unit, links * count[place])
                running = np.zeros((6, len(code) + 1), dtype=np.int64)
                if len(code):
                    running[:, 1:] = np.cumsum(sums[:, back], axis=1)
                total = np.where(clean, running[:, bounds[1:]] - running[:, bounds[:-1]], 0)
                before = [batch.column(k).slice(start, len(texts)) for k in range(3, 5)]  # of earlier rounds
                total[4:] += np.stack([b.to_numpy() for b in before])
                sha = [None] * len(texts)
                if last:
                    groups = both.groups
                    for k in range(len(texts)):
                        sha[k] = "" if not clean[k] else hashlib.sha256(b"".join([groups[c] for c in code[bounds[k] : bounds[k + 1]].tolist()])[:-1]).hexdigest()
                columns = [batch.column(0).slice(start, len(texts))] + ([] if last else [batch.column(1).slice(start, len(texts))])
                yield pa.RecordBatch.from_arrays(columns + [pa.array(x) for x in total] + [pa.array(sha, pa.string())], names)
        give_back()

    return run


def align_vocabularies(docs: DataFrame, first: str, second: str, shards: int = SHARDS, fan: int = FAN, hold: int = HOLD,
                       round_bytes: int = ROUND_BYTES) -> DataFrame:
    """How each text's tokens under two vocabularies lie over each other.

    ``first`` is a byte-level vocabulary file and encodes a blank and the text, ``second`` a piece model, which adds that
    blank itself; neither makes special tokens. A row per row of ``docs``: ``doc_id, n_a, n_b`` (tokens), ``n_groups`` (parts
    between bytes where both end), ``n_links`` (pairs of occurrences that share a group), ``n_best`` (links whose pair is
    linked in as many rows as any pair of its first id), ``count_sum`` (those numbers of rows, over all links) and
    ``groups_sha256`` of ``a1,a2|b1;a3|b2``. Texts that are null, empty, or that either vocabulary doesn't give back byte by
    byte have no tokens: zeros, and an empty string. Rows that repeat count as often; a null ``doc_id`` stays null; other
    columns are ignored. Counts are looked up in tables broadcast ``round_bytes`` at a time; the driver passes them on in
    rounds and holds one, and each further round reads the texts again.
    """
    spark = docs.sparkSession
    tables = cut_lineage(pair_tables(docs, first, second, shards, fan, hold))
    highest = np.zeros(len(vocabularies(first, second).a_bytes) + 1, dtype=np.int64)
    one = tables.select(F.explode(F.arrays_zip("ids", "best")).alias("x")).groupBy("x.ids").agg(F.max("x.best").alias("best"))
    for k, n in one.collect():  # at most one row per entry of the first vocabulary
        highest[k] = n
    rounds: list[list[int]] = [[]]
    size = 0
    for shard, n in tables.select("shard", "n").orderBy("shard").collect():
        if rounds[-1] and size + n * ENTRY_BYTES > round_bytes:
            rounds.append([])
            size = 0
        rounds[-1].append(shard)
        size += n * ENTRY_BYTES
    best = spark.sparkContext.broadcast(highest)
    none = [F.lit(0).cast("long").alias(c) for c in ("n_best", "count_sum")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).alias("round"), *none)
    for k, own in enumerate(rounds):
        last = k == len(rounds) - 1
        held = [tuple(r) for r in tables.where(F.col("shard").isin(own)).select("shard", "keys", "hash", "counts").collect()] if own else []
        run = _look_up(first, second, spark.sparkContext.broadcast(held), best, shards, last)
        found = rows.mapInArrow(run, "doc_id long, " + ("" if last else "text string, ") + SUMS)
        if not last:
            found = cut_lineage(found)
            rows = found.select("doc_id", "text", F.lit(0).alias("round"), "n_best", "count_sum")
    return found
