"""Document quality from weak labels.

Heuristic labellers look at whole texts and vote good, bad or not at all. How often each pattern of votes occurs is
counted over all documents; expectation-maximisation on these counts estimates how each labeller votes on good texts
and on several kinds of bad ones, without any true label. The posterior of its pattern is a text's soft label. A linear scorer over hashed
features is trained on the soft labels of a bounded sample, and scores every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.textbuf import Chunk, byte_spans, chunks, give_back, mix

#: Documents that the scorer is trained on, about; equal feature sets count once, with their number.
SAMPLE = 8000
FEATURE_BITS = 14
KEEP_FROM = 0.4
SEED = 5
#: Where expectation-maximisation starts: share of good texts, and how often a labeller votes bad on a good text, on the
#: kind of bad text that is its own, and on other kinds.
START_GOOD, START_WRONG, START_OWN, START_OTHER = 0.8, 0.02, 0.9, 0.2

_UPPER, _LETTER, _ODD, _STOP = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_ODD[[ord(c) for c in "#$%&*|~^<>{}[]\\=_+@"]] = True
_STOP[[ord(c) for c in ".,;:?!"]] = True
#: Bytes by kind: letters of either case, digits, line ends and blanks; signs stand for themselves.
_KIND = np.arange(256, dtype=np.uint8)
_KIND[_LETTER] = ord("a")
_KIND[_UPPER] = ord("A")
_KIND[48:58] = ord("0")
_KIND[[9, 11, 12, 13]] = 32

LABELLERS = ("odd_signs", "capitals", "repeated_words", "sentence_ends", "word_length", "repeated_lines", "short_words", "plain_words", "bare_signs")


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.append(0, np.cumsum(flags))[bounds])


class Facts:
    """What the labellers and the scorer look at, for each text of a chunk."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        data, bounds = chunk.data, chunk.bounds
        self.start, self.end, self.first = chunk.words()
        self.words = np.diff(self.first)
        n = np.maximum(self.words, 1)
        of_word = np.repeat(np.arange(len(chunk)), self.words)
        self.codes = byte_spans(data).hash(self.start, self.end)
        letters = np.maximum(_per_text(_LETTER[data], bounds), 1)
        self.odd = _per_text(_ODD[data], bounds) / n
        self.capitals = _per_text(_UPPER[data], bounds) / letters
        lettered = np.diff(np.append(0, np.cumsum(_LETTER[data]))[np.stack((self.start, self.end), axis=1)], axis=1)[:, 0] > 0
        digit = np.append(0, np.cumsum((data >= 48) & (data < 58)))
        self.bare = _per_text(~lettered & (digit[self.end] == digit[self.start]), self.first) / n
        self.same = np.zeros(len(self.codes), dtype=bool)
        self.same[1:] = (self.codes[1:] == self.codes[:-1]) & (of_word[1:] == of_word[:-1]) & lettered[1:]
        self.repeats = _per_text(self.same, self.first) / n
        self.ends = _per_text(_STOP[data[self.end - 1]], self.first) / n
        size = self.end - self.start
        self.length = np.diff(np.append(0, np.cumsum(size))[self.first]) / n
        self.short = _per_text(size <= 3, self.first) / n
        inner = np.append(0, np.cumsum(~_LETTER[data]))
        self.plain = _per_text(inner[np.maximum(self.end - 1, self.start)] - inner[self.start] == 0, self.first) / n
        # lines by hash; a line is repeated where an equal one of some length is in the same text
        brk = np.flatnonzero(data == 10)
        line_start = np.unique(np.concatenate((bounds[:-1], brk + 1)))
        line_start = line_start[line_start < len(data)]
        line_end = np.append(line_start[1:], len(data))
        of_line = np.searchsorted(bounds, line_start, side="right") - 1
        long_ = line_end - line_start > 10
        h = mix(byte_spans(data).hash(line_start, np.maximum(line_end - 1, line_start)) + of_line.astype(np.uint64))[long_]
        _, back, count = np.unique(h, return_inverse=True, return_counts=True)
        self.lines = np.bincount(of_line[long_], minlength=len(chunk))
        self.line_repeats = np.bincount(of_line[long_], weights=count[back] > 1, minlength=len(chunk)) / np.maximum(self.lines, 1)

    def votes(self) -> np.ndarray:
        """A row per text, a column per labeller: 1 for good, 2 for bad, 0 for no vote."""
        some, many = self.words >= 5, self.words >= 20
        vote = lambda good, bad, able: np.where(able & bad, 2, np.where(able & good, 1, 0))
        return np.stack([
            vote(self.odd < 0.05, self.odd > 0.25, some),
            vote(self.capitals < 0.2, self.capitals > 0.5, some),
            vote(self.repeats < 0.1, self.repeats > 0.3, many),
            vote((self.ends > 0.02) & (self.ends < 0.4), (self.ends == 0) | (self.ends > 0.7), many),
            vote((self.length > 2.5) & (self.length < 9), (self.length < 2) | (self.length > 14), some),
            vote(self.line_repeats < 0.1, self.line_repeats > 0.5, self.lines >= 4),
            vote((self.short > 0.12) & (self.short < 0.7), (self.short < 0.05) | (self.short > 0.85), many),
            vote(self.plain > 0.8, self.plain < 0.5, some),
            vote(self.bare < 0.05, self.bare > 0.2, some),
        ], axis=1)

    def features(self, bits: int = FEATURE_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
        """Hashed features of each text with their weights, of length one: runs of three and five byte kinds, and words
        that were just there, all as shares of the text."""
        kind = _KIND[self.chunk.data].astype(np.uint64)
        out, bounds = [], self.chunk.bounds
        grams = []
        for n in (3, 5):
            code = np.zeros(max(0, len(kind) - n + 1), dtype=np.uint64)
            for k in range(n):
                code = (code << np.uint64(8)) | kind[k : len(kind) - n + 1 + k]
            grams.append((n, (mix(code + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64)))
        again = np.append(0, np.cumsum(self.same))
        special = {k: int(mix(np.array([k], dtype=np.uint64))[0] >> np.uint64(64 - bits)) for k in (1001, 1002)}
        for k in range(len(self.chunk)):
            a, b = bounds[k], bounds[k + 1]
            counts = np.zeros(1 << bits)
            for n, code in grams:
                if b - a >= n:
                    counts += np.bincount(code[a : b - n + 1], minlength=1 << bits)
            counts[special[1001]] += 20 * (again[self.first[k + 1]] - again[self.first[k]])
            counts[special[1002]] += 20 * self.line_repeats[k] * self.words[k]
            index = np.flatnonzero(counts)
            value = np.sqrt(counts[index])
            out.append((index, value / max(1e-9, np.sqrt((value**2).sum()))))
        return out


def vote_patterns(docs: DataFrame) -> dict[int, int]:
    """How many documents have each pattern of votes, over all documents: at most 3 to the number of labellers entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                facts = Facts(chunk)
                for p, n in zip(*np.unique(_pattern(facts.votes())[facts.words > 0], return_counts=True), strict=True):
                    seen[int(p)] = seen.get(int(p), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    rows = docs.select("text").mapInArrow(run, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return {r["pattern"]: r["n"] for r in rows.collect()}


def _pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def label_model(patterns: dict[int, int], turns: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the kinds of text, and for each kind how often each labeller, if it votes, votes good (1) and bad (2).

    Kind 0 is good; bad texts are bad in different ways, and votes that overlap on one way are not independent over all
    bad texts, so there is a bad kind for each labeller, which starts as what that labeller is nearly sure to call bad.
    Abstaining says nothing. Each turn weighs patterns by the posterior of each kind and counts votes again.
    """
    votes = np.array(sorted(patterns))[:, None] // (3 ** np.arange(len(LABELLERS))) % 3
    weight = np.array([patterns[p] for p in sorted(patterns)], dtype=np.float64)
    kinds = len(LABELLERS) + 1
    real = np.append(1.0, (votes == 2).any(axis=0))  # a labeller that never blames a text has no kind of its own
    share = np.append(START_GOOD, np.full(kinds - 1, (1 - START_GOOD) / (kinds - 1))) * np.maximum(real, 1e-12)
    table = np.ones((kinds, len(LABELLERS), 3))
    table[0, :, 2], table[1:, :, 2] = START_WRONG, START_OTHER
    table[np.arange(1, kinds), np.arange(kinds - 1), 2] = START_OWN
    table[:, :, 1] = 1 - table[:, :, 2]
    for _ in range(turns):
        part = kind_posteriors(share, table, votes) * weight[:, None]
        share = np.maximum((part.sum(axis=0) + 1) / (weight.sum() + kinds) * real, 1e-12)
        counts = np.stack([(votes == v).T.astype(np.float64) @ part for v in (1, 2)], axis=2).transpose(1, 0, 2) + 0.5
        table[:, :, 1:] = counts / counts.sum(axis=2, keepdims=True)
    return share, table


def kind_posteriors(share: np.ndarray, table: np.ndarray, votes: np.ndarray) -> np.ndarray:
    at = np.arange(votes.shape[1])
    score = np.log(share)[None, :] + np.stack([np.log(t[at, votes]).sum(axis=1) for t in table], axis=1)
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def posteriors(share: np.ndarray, table: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Probability that a text is good, from its votes."""
    return kind_posteriors(share, table, votes)[:, 0]


def train_scorer(rows: list, bits: int = FEATURE_BITS, turns: int = 150, rate: float = 1.0, decay: float = 1e-6) -> np.ndarray:
    """Logistic regression on soft labels by full gradients with a step size per weight; the last weight is the bias."""
    weights = np.zeros((1 << bits) + 1)
    if not rows:
        return weights
    index = np.concatenate([np.frombuffer(r["index"], dtype="<i4") for r in rows])
    value = np.concatenate([np.frombuffer(r["value"], dtype="<f4") for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r["index"]) // 4 for r in rows])
    label = np.array([r["label"] for r in rows])
    times = np.array([r["n"] for r in rows], dtype=np.float64)
    # each side of the label gets the same weight in all
    times *= np.where(label >= 0.5, 0.5 / max(1.0, times[label >= 0.5].sum()), 0.5 / max(1.0, times[label < 0.5].sum()))
    sums = np.full(len(weights), 1e-12)
    for _ in range(turns):
        score = np.bincount(row, weights=value * weights[index], minlength=len(rows)) + weights[-1]
        slip = times * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - label)
        step = np.append(np.bincount(index, weights=slip[row] * value, minlength=len(weights) - 1), slip.sum()) + decay * weights
        sums += step**2
        weights -= rate * step / np.sqrt(sums)
    return weights


def fit(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The scorer's weights. Vote counts cover all documents; only the scorer itself is trained on a sample."""
    patterns = vote_patterns(docs)
    if not patterns:
        return train_scorer([])
    share, table = label_model(patterns)
    part = min(1.0, sample / sum(patterns.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                facts = Facts(chunk)
                label = posteriors(share, table, facts.votes())
                own = [(i, v, p) for (i, v), p, w in zip(facts.features(), label, facts.words, strict=True) if w]
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([i.astype("<i4").tobytes() for i, _, _ in own], pa.binary()),
                                                      pa.array([v.astype("<f4").tobytes() for _, v, _ in own], pa.binary()),
                                                      pa.array([float(p) for _, _, p in own])], ["index", "value", "label"])

    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < int(part * (1 << 30)) + (part == 1.0)
    rows = docs.where(drawn).select("text").mapInArrow(run, "index binary, value binary, label double")
    rows = rows.groupBy("index", "value", "label").agg(F.count(F.lit(1)).alias("n"))
    return train_scorer(sorted((r.asDict() for r in rows.collect()), key=lambda r: (r["index"], r["value"])))


def _score(weights, names: list[str], text_at: int, keep_from: float, only_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for chunk in chunks(batch.column(text_at)):
                facts = Facts(chunk)
                score = np.array([np.dot(v, w[i]) for i, v in facts.features()]) + w[-1]
                score = np.where(facts.words > 0, 1 / (1 + np.exp(-np.clip(score, -50, 50))), 0.0)
                kept = score >= keep_from
                part = batch.slice(chunk.first, len(chunk))
                if only_kept:
                    yield part.filter(pa.array(kept)).rename_columns(names)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array(kept)], names)
        give_back()

    return run


def score_documents(docs: DataFrame, keep_from: float = KEEP_FROM, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, score`` (0 to 1, good texts high) and ``kept`` of each row.

    A text without words, a null one too, scores 0. Rows are scored on their whole text alone, so rows that repeat agree.
    Where the table is empty, so is the result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    return docs.mapInArrow(_score(weights, ["doc_id", "score", "kept"], 1, keep_from, False), "doc_id long, score double, kept boolean")


def good_documents(docs: DataFrame, columns: list[str], keep_from: float = KEEP_FROM, sample: int = SAMPLE) -> DataFrame:
    """The rows that the scorer keeps, with ``columns`` as they are."""
    rows = docs.select(*columns)
    weights = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text"), sample))
    return rows.mapInArrow(_score(weights, columns, columns.index("text"), keep_from, True), rows.schema)
