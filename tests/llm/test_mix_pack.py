"""Mixing and packing against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from larder.llm import jaccard, mixing, packing, quality
from larder.llm.queries import tokenizer_path
from larder.llm.texts import text_key
from tests.llm.data import documents, messy_texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def mix_docs(spark):
    rng = random.Random(2)
    texts = [None, "", "  "] + [words(rng, rng.choice((1, 5, 60, 300))) for _ in range(90)]
    return documents(spark, texts + texts[5:9], [*range(len(texts)), 5, 6, None, None]), texts


@pytest.mark.parametrize("limits", [{}, {"bucket_words": 500, "shard_slots": 16, "block_words": 8}])
def test_mix(spark, limits):
    docs, _ = mix_docs(spark)
    rows = mixing.taken_words(mixing.plan_mix(docs, **limits)).collect()
    again = mixing.taken_words(mixing.plan_mix(docs.repartition(7), **limits)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    want = sorted((str(r["doc_id"]), len(WORD.findall(r["text"] or "")), str(r["source"])) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["size"], str(r["source"])) for r in rows) == want
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    for s, n in size.items():
        assert all(r["source_size"] == n for r in rows if r["source"] == s)
        assert abs(taken[s] - target[s]) <= 2 * limits.get("block_words", mixing.BLOCK_WORDS)


def test_targets():
    assert mixing.target_words([100, 100, 100], [5, 2, 1], 1.5, 2) == pytest.approx([200, 500 / 3, 250 / 3])
    assert mixing.target_words([0, 10], [5, 2], 1.5, 2) == pytest.approx([0, 15])
    assert mixing.target_words([], [], 1.5, 2) == []


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        index, size = np.arange(n), np.full(n, n)
        a, b = (mixing.permuted(index, size, np.full(n, k, dtype=np.uint64)) for k in (5, 6))
        assert sorted(a) == sorted(b) == list(range(n))
        assert n < 17 or (a != b).any()


def test_mixed_documents_hold_the_words_taken(spark):
    docs, _ = mix_docs(spark)
    mix = mixing.plan_mix(docs, block_words=8)
    taken, got = Counter(), Counter()
    for r in mixing.taken_words(mix).collect():
        taken[r["doc_id"]] += r["taken"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = mixing.mixed_documents(docs, mix, columns).collect()
    texts = defaultdict(set)
    for r in docs.collect():
        texts[r["doc_id"]] |= set(WORD.findall(r["text"] or ""))
    for r in rows:
        got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert set(WORD.findall(r["text"])) <= texts[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert +taken == +got


def test_mix_of_nothing(spark):
    assert mixing.taken_words(mixing.plan_mix(documents(spark, ["a"]).where("false"))).count() == 0
    assert [r["taken"] for r in mixing.taken_words(mixing.plan_mix(documents(spark, [None, ""]))).collect()] == [0, 0]


@pytest.mark.parametrize("shard", [200_000, 20])
def test_packing(spark, shard):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = [*messy_texts(), "don't <|endoftext|>, it's 'S !'s", "İ K ﬁ x…. <|EndOfText|>", "é́ naïve,", "日本 12,3"]
    docs = documents(spark, texts)
    capacity = 64
    rows = packing.pack_documents(docs, tokenizer_path(), capacity, with_ids=True, shard_pieces=shard).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [i for r in pieces for i in r["ids"]] == ids
        assert [r["start"] for r in pieces] == list(range(0, len(ids), capacity)) and all(r["length"] == capacity for r in pieces[:-1])
        for r in pieces:
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    if shard > 1000:
        assert len(by_sequence) == len(slow_best_fit([r["length"] for r in rows], capacity))


def slow_best_fit(lengths: list[int], capacity: int) -> list[int]:
    bins: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(capacity - n)
    return bins


def test_best_fit_is_that_of_a_plain_search():
    rng = np.random.default_rng(0)
    for capacity in (1, 7, 64, 100):
        lengths = rng.integers(1, capacity + 1, 300)
        bins, offsets = packing.best_fit_decreasing(lengths, capacity)
        assert bins.max() + 1 == len(slow_best_fit(lengths.tolist(), capacity))
        assert np.bincount(bins, weights=lengths).max() <= capacity and (offsets + lengths <= capacity).all()


def test_packing_edges(spark):
    docs = documents(spark, [None, "", "a", "a"], [None, 2, 3, 3])
    rows = packing.pack_documents(docs, tokenizer_path()).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("2", 1), ("3", 2), ("3", 2), ("None", 1)]
    assert len({r["sequence_id"] for r in rows}) == 1
    assert packing.pack_documents(docs.where("false"), tokenizer_path()).count() == 0
    ids = [9007199254740993, 9007199254740995, None, -1, 0]
    rows = packing.pack_documents(documents(spark, ["a"] * 5, ids), tokenizer_path()).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(ids)  # null beside ids that no double holds


def test_mixed_documents_of_any_columns(spark):
    """Extra columns whose names clash with those used inside are kept as they are."""
    docs = documents(spark, [words(random.Random(k), 40) for k in range(30)])
    names = ["doc_id_", "text_hash_", "source_", "words_", "cuts_", "size_", "part_doc_id", "row_doc_id", "runs", "listed", "mixed_text", "c0"]
    docs = docs.select("*", *[docs.doc_id.cast("string").alias(c) for c in names])
    columns = [*corpus_pipeline.COLUMNS, *names]
    rows = mixing.mixed_documents(docs, mixing.plan_mix(docs), columns).collect()
    assert rows and all(r[c] == str(r["doc_id"]) for r in rows for c in names)


def test_pipeline_stages(spark, tmp_path):
    """Each stage works on what the one before it kept; its rows are those that its operator's own results call for."""
    docs = documents(spark, [*messy_texts(), *messy_texts()[:20]]).select(*corpus_pipeline.COLUMNS)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == corpus_pipeline.COLUMNS
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, docs)
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    before, after = kept["good_quality"]
    assert ids(after) == ids(quality.score_documents(before).where("kept")) and 0 < after.count() < before.count()
    before, after = kept["one_of_near_duplicates"]
    assert ids(after) == ids(jaccard.jaccard_join(before).where("kept")) and after.count() < before.count()
    before, after = kept["without_repeats"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    passage, first = corpus_pipeline.PASSAGE_BYTES, {}
    order = {r["doc_id"]: (r["h1"], r["h2"]) for r in before.select("doc_id", *[c.alias(f"h{k}") for k, c in enumerate(text_key(), 1)]).collect()}
    for i in sorted(texts, key=order.__getitem__):
        raw = texts[i].encode()
        for k in range(len(raw) - passage + 1):
            first.setdefault(raw[k : k + passage], (i, k))
    want = {}
    for i, text in texts.items():
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for k in range(len(raw) - passage + 1):
            if first[raw[k : k + passage]] != (i, k):
                gone[k : k + passage] = True
        at, left = 0, ""
        for sign in text:  # a sign stays unless all of its bytes go
            size = len(sign.encode())
            left += "" if gone[at : at + size].all() else sign
            at += size
        if not len(raw) or not gone.all():
            want[i] = left
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect()) and want != texts
    before, after = kept["mix_sources"]
    assert set(ids(after)) <= set(ids(before))
    total, mixed = (sum(len(WORD.findall(r["text"])) for r in df.collect()) for df in (before, after))
    assert abs(mixed - 1.5 * total) <= 3 * mixing.BLOCK_WORDS
    before, after = kept["pack_sequences"]
    assert after.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 4096").count() == 0
    assert ids(before) == ids(after.where("piece = 0"))
