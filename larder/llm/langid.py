"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams are counted over every document that may be learnt from. Weights are trained on a
bounded sample by follow-the-regularised-leader with L1 and L2 penalties, and a temperature, fitted on a part of the
sample kept out of training, turns scores into probabilities. Every text is then scored whole, from itself alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.textbuf import chunks, mix

BITS = 14
ORDERS = (1, 2, 3)
#: Documents of each language that weights are trained on, about, and the share of them kept for the temperature.
SAMPLE_PER_LANGUAGE = 2000
HELD_FOR_TEMPERATURE = 0.2
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-5
SEED = 3
UNKNOWN = "und"
_PLANES = 0x20000


@cache
def letter_table() -> np.ndarray:
    """For each code point below U+20000 the lower-case letter it is, or a blank; what lies above counts as letters."""
    out = np.full(_PLANES, 32, dtype=np.uint32)
    for c in range(_PLANES):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's texts as lower-case letters and blanks, and where each begins."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
    places = np.append(0, np.cumsum((data & 0xC0) != 0x80))[bounds]
    table = letter_table()
    return np.where(points < _PLANES, table[np.minimum(points, _PLANES - 1)], points), places


def gram_codes(points: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Bucket of each n-gram of each order, by its first letter."""
    wide, out = points.astype(np.uint64), []
    code = np.zeros(len(wide) + 1, dtype=np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = (code[: len(wide) - n + 1] << np.uint64(21)) | wide[n - 1 :] if len(wide) >= n else code[:0]
        if n in ORDERS:
            out.append((n, (mix(code + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64)))
    return out


def gram_counts(data: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray | None]:
    """For each text how often each bucket occurs; None for a text without a letter. Runs of blanks count once."""
    points, places = letters_of(data, bounds)
    blank = points == 32
    keep = ~(blank & np.append(False, blank[:-1]))
    keep[places[:-1][places[:-1] < len(points)]] = True
    places = np.append(0, np.cumsum(keep))[places]
    points = points[keep]
    letters = np.append(0, np.cumsum(points != 32))[places]
    codes = gram_codes(points)
    for k in range(len(bounds) - 1):
        a, b = places[k], places[k + 1]
        if letters[k + 1] == letters[k]:
            yield None
            continue
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for n, code in codes:
            if b - a >= n:
                counts += np.bincount(code[a : b - n + 1], minlength=1 << BITS)
        yield counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index = np.flatnonzero(counts)
    value = np.log1p(counts[index]) * idf[index]
    return index, value / max(1e-12, np.sqrt((value**2).sum()))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per bucket and one for the bias, a column per language
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        index, value = weighted(counts, self.idf)
        return softmax((value @ self.weights[index] + self.weights[-1]) / self.temperature)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class FollowTheLeader:
    """FTRL-proximal: each weight is the leader's answer to all gradients so far under L1 and L2 penalties."""

    def __init__(self, features: int, classes: int):
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))

    def weights(self, index=slice(None)) -> np.ndarray:
        z = self.z[index]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[index])) / ALPHA + L2))

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        slip = softmax(value @ w)
        slip[label] -= 1
        g = value[:, None] * slip[None, :]
        n = self.n[index]
        self.z[index] += g - (np.sqrt(n + g**2) - np.sqrt(n)) / ALPHA * w
        self.n[index] = n + g**2


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> Model:
    """``rows`` have a language's number, feature indexes and values; their order does not matter."""
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    cut = int(len(rows) * HELD_FOR_TEMPERATURE) if len(rows) >= 20 else 0
    held, learnt = order[:cut], order[cut:]
    leader, bias = FollowTheLeader((1 << BITS) + 1, len(languages)), 1 << BITS
    for _ in range(EPOCHS):
        for k in rng.permutation(learnt):
            label, index, value = rows[k]
            leader.learn(np.append(index, bias), np.append(value, 1.0), label)
    weights = leader.weights()
    temperature = 1.0
    if cut:
        score = np.stack([rows[k][2] @ weights[rows[k][1]] + weights[-1] for k in held])
        label = np.array([rows[k][0] for k in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(score / t)[np.arange(len(label)), label], 1e-12)).mean() + 1e-4 * abs(np.log(t)) for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return Model(languages, idf, weights, temperature)


def is_held_out() -> Column:
    """Documents whose CRC of the id's text leaves 2 modulo 4; not those without an id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many texts each bucket occurs; the last entry is the number of texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, dtype=np.int64)
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                for counts in gram_counts(chunk.data, chunk.bounds):
                    if counts is not None:
                        total[:-1] += counts > 0
                        total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros((1 << BITS) + 1, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model of the rows of ``doc_id, text, lang`` that are not held out and have an id and a language."""
    known = docs.where(~is_held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    totals = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not totals:
        return None
    languages = sorted(totals)
    number = {x: k for k, x in enumerate(languages)}
    frequency = document_frequencies(known)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    share = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, sample_per_language / totals[x]))])
    drawn = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(1).to_pylist()
            for chunk in chunks(batch.column(0)):
                own = [(number[lang[chunk.first + k]], *weighted(c, idf)) for k, c in enumerate(gram_counts(chunk.data, chunk.bounds)) if c is not None]
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in own], pa.int32()), pa.array([x[1].astype("<i4").tobytes() for x in own], pa.binary()),
                         pa.array([x[2].astype("<f4").tobytes() for x in own], pa.binary())], ["label", "index", "value"])

    # rows that repeat are learnt from once, so that copies cannot fill the sample
    rows = known.where(drawn).select("text", "lang").mapInArrow(run, "label int, index binary, value binary").distinct().collect()
    rows = sorted((r["label"], bytes(r["index"]), bytes(r["value"])) for r in rows)
    if not rows:
        return None
    return train([(a, np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for a, i, v in rows], languages, idf)


def predict_language(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of each row.

    A text that is null or has no letter, or any text where there was nothing to learn from, is ``und`` with a score of 0.
    Equal probabilities go to the first language by code point. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_per_language))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = []
                for counts in gram_counts(chunk.data, chunk.bounds):
                    if counts is None or m is None:
                        found.append((UNKNOWN, 0.0))
                    else:
                        p = m.probabilities(counts)
                        best = int(np.argmax(p))
                        found.append((m.languages[best], float(p[best])))
                part = batch.slice(chunk.first, len(chunk))
                lang, score = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score, pa.float64())],
                                                 ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", is_held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
