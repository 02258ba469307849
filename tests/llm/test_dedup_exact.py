"""Exact substring dedup by bytes (suffixes) and by word windows, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from larder.llm import substrings, suffixes
from larder.llm.texts import text_key
from tests.llm.data import documents, messy_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bytes_removed(texts: list, length: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[k : k + length] for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, dtype=bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                gone[k + 1 : k + 1 + length] = True
        kept = bytes(b for k, b in enumerate(r) if not gone[k + 1])
        out.append((len(r), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def words_removed(ids: list, texts: list, window: int) -> list[tuple]:
    big = 1 << 62
    words = [WORD.findall(t or "") for t in texts]
    first: dict = defaultdict(lambda: big + 1)
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first[key], big if i is None else i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (big if i is None else i):
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_two_stages_give_the_suffix_order():
    rng = random.Random(5)
    for _ in range(100):
        text = np.array([rng.randrange(1, 4) for _ in range(rng.randrange(1, 60))] + [0])
        order = suffixes.two_stage_order(text, 64)
        assert order.tolist() == sorted(range(len(text)), key=lambda k: text[k:].tolist())
        common = suffixes.common_prefixes(suffixes.Prefixes(text), order, 5)
        for a, b, n in zip(order[:-1], order[1:], common[1:], strict=True):
            same = [x == y for x, y in zip(text[a:], text[b:], strict=False)] + [False]
            assert n == min(5, same.index(False))


@pytest.mark.parametrize(("length", "core", "group"), [(40, 20, 1 << 12), (40, 33, 1 << 12), (40, 20, 1), (40, 20, 3), (400, 208, 1 << 12)])
def test_suffix_dedup(spark, length, core, group):
    """Groups that are split give the same rows as whole ones."""
    texts = messy_texts()
    got = {r["doc_id"]: r for r in suffixes.dedup_suffixes(documents(spark, texts), length, core, group, with_text=True).collect()}
    assert len(got) == len(texts)
    for k, want in enumerate(bytes_removed(texts, length)):
        assert tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, texts[k]
        if want[1] == 0:
            assert got[k]["kept_text"] == (texts[k] or "")


@pytest.mark.parametrize("group", [1 << 12, 1])
def test_suffix_dedup_at_the_edges_of_texts(spark, group):
    """Many texts share how they begin, or how they end: spans of groups that are split end with their text."""
    rng = random.Random(0)
    letters = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    head, middle, tail = letters(30), letters(45), letters(33)
    texts = []
    for _ in range(40):
        texts.append(head[: rng.choice([25, 28, 30, 30])] + letters(rng.randrange(30)))
        texts.append(letters(rng.randrange(30)) + tail[rng.choice([0, 0, 3, 6]) :])
        texts.append(letters(rng.randrange(8)) + middle + letters(rng.randrange(8)))
        texts.append(middle[rng.randrange(6) : 45 - rng.randrange(6)])
    got = {r["doc_id"]: r for r in suffixes.dedup_suffixes(documents(spark, texts), 20, 10, group).collect()}
    for k, want in enumerate(bytes_removed(texts, 20)):
        assert tuple(got[k][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) == want, texts[k]


@pytest.mark.parametrize("group", [1 << 12, 2])
def test_suffix_dedup_keeps_first(spark, group):
    """Of equal strings only those stay that come first by the text's hash, then by place; copies of a text are one text."""
    length, texts = 40, [t for k, t in enumerate(dict.fromkeys(messy_texts())) if t != "ab" * 350]
    ids = list(range(len(texts)))
    docs = documents(spark, texts + texts[9:12] * 3, ids + [ids[9], 1000, -5, *range(2000, 2006)])
    rows = suffixes.dedup_suffixes(docs, length, 20, group, keep_first=True).collect()
    assert len(rows) == len(texts) + 9
    got = {r["doc_id"]: r for r in rows}
    first: dict[bytes, tuple] = {}
    raw = {i: (t or "").encode() for i, t in zip(ids, texts, strict=True)}
    order = {r["doc_id"]: (r["h1"], r["h2"]) for r in docs.select("doc_id", *[c.alias(f"h{k}") for k, c in enumerate(text_key(), 1)]).collect()}
    for i in sorted(ids, key=order.__getitem__):
        for k in range(len(raw[i]) - length + 1):
            first.setdefault(raw[i][k : k + length], (i, k))
    for i, r in raw.items():
        gone = np.zeros(len(r), dtype=bool)
        for k in range(len(r) - length + 1):
            if first[r[k : k + length]] != (i, k):
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), r


def test_suffix_dedup_rows(spark):
    """Repeated rows and null ids are occurrences of their own; an empty table gives no rows."""
    text = messy_texts()[10]
    got = suffixes.dedup_suffixes(documents(spark, [text, text, text], [1, 1, None]), 20, 10).collect()
    assert [r["n_removed"] for r in got] == [len(text.encode())] * 3
    assert suffixes.dedup_suffixes(documents(spark, ["a"]).where("false")).count() == 0


@pytest.mark.parametrize("bits", [None, 3])
def test_substring_dedup(spark, bits):
    """A sketch far too small lets more windows through and gives the same result."""
    texts = messy_texts()
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    ids = [None if i in (9, 20) else i for i in ids]
    got = substrings.dedup_substrings(documents(spark, texts, ids), sketch_bits=bits, with_text=True, bucket_windows=16).collect()
    want = sorted(zip(map(str, ids), words_removed(ids, texts, 13), strict=True))
    assert sorted((str(r["doc_id"]), (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == want
    assert sum(x[1][1] for x in want) > 500


def test_substring_dedup_rows(spark):
    text = " ".join(f"w{k}" for k in range(14))
    got = substrings.dedup_substrings(documents(spark, [text, text, text, None], [4, 4, 9, 3])).collect()
    n = len(WORD.findall(text))
    assert sorted((r["doc_id"], r["n_removed"]) for r in got) == [(3, 0), (4, 0), (4, 0), (9, n)]
    assert substrings.dedup_substrings(documents(spark, ["a"]).where("false")).count() == 0


@pytest.mark.parametrize("tied", [None, 5])
def test_texts_of_one_least_owner_are_all_marked(monkeypatch, tied):
    """Different texts with null ids, or of one id, share a window that a smaller document of another hold has too."""
    monkeypatch.setattr(substrings, "HOLD", 1)
    passage = words(random.Random(6), 13)
    rows = [[(tied, 11, f"a {passage} b {passage}"), (tied, 12, f"c {passage} d"), (tied, 13, f"e {passage}")], [(1, 21, f"f {passage} g")]]
    sketch = SimpleNamespace(value=np.full((substrings.DEPTH, 1 << 13), 255, dtype=np.uint8))
    names = ["owner", "k1", "k2", "text"]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*((o, k, k, text) for o, k, text in r), strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)
               for r in rows]
    dealt = list(substrings._deal(sketch, 16, 1, 13, 6)(iter(batches)))
    marked = [k for b in substrings._group(iter(dealt)) for k in b.column(0).to_pylist()]
    assert sorted(marked) == [11, 12, 13]


def test_substring_dedup_null_ids_over_partitions(spark):
    rng = random.Random(7)
    passage = words(rng, 20)
    texts = [f"{words(rng, 5)} {passage} {words(rng, 5)}" for _ in range(16)]
    ids = [0] + [None] * 15
    names = {"spark.sql.shuffle.partitions": "3", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, x in names.items():
            spark.conf.set(k, x)
        got = substrings.dedup_substrings(documents(spark, texts, ids)).collect()
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    want = sorted(zip(map(str, ids), words_removed(ids, texts, 13), strict=True))
    assert sorted((str(r["doc_id"]), (r["n_words"], r["n_removed"], r["kept_sha256"])) for r in got) == want
