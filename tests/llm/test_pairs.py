"""Jaccard join, near vectors and nearest neighbours against brute force."""

from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pytest

from larder.llm import crosspolytope, jaccard, neighbours
from larder.llm.components import components
from tests.llm.data import documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closed(nodes: list, links: list[tuple]) -> dict:
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def shingles(text: str | None) -> frozenset:
    w = WORD.findall(text or "")
    return frozenset([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else []))


def near_texts() -> list:
    rng = random.Random(8)
    texts = [None, "", " ", "one two", "one  two", "one two"]
    for _ in range(25):
        base = words(rng, rng.randrange(6, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            other = list(base)
            for _ in range(rng.randrange(0, 4)):
                other[rng.randrange(len(other))] = "q"
            texts.append(" ".join(other))
    hot = words(rng, 100).split()
    for k in range(40):
        other = list(hot)
        other[k * 2] = f"z{k}"
        texts.append(" ".join(other))
    return texts + [texts[-1]] * 5


@pytest.mark.parametrize("limits", [{}, {"slice_texts": 7}, {"slice_bytes": 3000}])
def test_jaccard_join(spark, limits):
    """Whole groups and groups split into slices have the same links, each counted once."""
    texts = near_texts()
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = closed(list(range(len(texts))), links)
    count = [0] * len(texts)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r["doc_id"]: r for r in jaccard.jaccard_join(documents(spark, texts), **limits).collect()}
    assert len(got) == len(texts) and max(count) > 30
    for k in range(len(texts)):
        assert (got[k]["class_id"], got[k]["n_links"], got[k]["kept"]) == (root[k], count[k], root[k] == k), texts[k]


@pytest.mark.parametrize("slice_bytes", [4000, 1000, 200])
def test_slices_without_texts_count_no_link_again(spark, slice_bytes):
    """A few long near copies in more slices than texts: pairs of one slice are counted once, not with each empty slice."""
    rng = random.Random(11)
    base = words(rng, 400).split()
    texts = [" ".join(base[:k] + ["q"] + base[k + 1 :]) for k in (0, 200, 399)]
    for few in (texts[:2], texts):
        got = jaccard.jaccard_join(documents(spark, few), slice_bytes=slice_bytes).collect()
        assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == [(k, 0, len(few) - 1) for k in range(len(few))]


def test_one_of_each_class_stays(spark):
    texts = near_texts()
    docs = documents(spark, texts)
    join = {r["doc_id"] for r in jaccard.jaccard_join(docs).collect() if r["kept"]}
    kept = jaccard.one_of_each(docs, ["doc_id", "text", "lang", "source", "n_chars"])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(join)
    twice = documents(spark, ["a b c d e f"] * 3, [7, 7, None])
    assert [r["doc_id"] for r in jaccard.one_of_each(twice, ["doc_id", "text", "source"]).collect()] == [7]
    assert jaccard.jaccard_join(docs.where("false")).count() == 0


def test_pruning_bounds():
    """A pair at the threshold is dropped with less than the tolerance; one far below it soon."""
    least = jaccard.least_matches(128, 0.8, 1e-6)
    rng = np.random.default_rng(0)
    drawn = (rng.random((20000, 128)) < 0.8).cumsum(axis=1)
    steps = [k for k in range(15, 128, 16)]
    assert (drawn[:, steps] >= least[[k + 1 for k in steps]]).all()
    assert least[32] > 11 and least[128] > 75


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(k, k + 1) for k in range(300, 340)] + [(500, 400 + k) for k in range(50)]
    root = closed(sorted({x for e in links for x in e}), links)
    got = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in got} == {n: root[n] for n in linked} and len(got) == len(linked)


VECTORS = "vec_id long, embedding array<float>, label int, code long, n long, t int"


def vectors(spark, rows: list) :
    return spark.createDataFrame([(i, v, c, 1, 2, 3) for i, v, c in rows], VECTORS).repartition(3)


def vector_rows() -> list:
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 4)):
            rows.append((base + rng.normal(size=16) * rng.choice((0.0, 0.05, 0.1, 0.2))).astype(np.float32).tolist())
    base = rng.normal(size=16)
    rows += [(base + rng.normal(size=16) * 0.04).astype(np.float32).tolist() for _ in range(70)] + [base.astype(np.float32).tolist()] * 10
    rows = [(k, v, (k // 90) % 2) for k, v in enumerate(rows)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], []]
    return rows + [(1000 + k, v, 1) for k, v in enumerate(odd)] + [(2000, rows[0][1], None)]


def usable(v) -> bool:
    return v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("slice_rows", [1024, 16])
def test_near_vectors(spark, slice_rows):
    rows = vector_rows()
    taking = [(i, np.array(v, dtype=np.float64), c) for i, v, c in rows if c is not None and usable(v)]
    links = []
    for (i, v, c), (j, w, d) in combinations(taking, 2):
        if c == d and len(v) == len(w) and v @ w / (np.sqrt(v @ v) * np.sqrt(w @ w)) >= 0.98:
            links.append((i, j))
    root = closed([r[0] for r in rows], links)
    got = {r["vec_id"]: r for r in crosspolytope.near_vectors(vectors(spark, rows), slice_rows=slice_rows).collect()}
    assert len(got) == len(rows) and len(links) > 1000
    for i, _, _ in rows:
        assert (got[i]["n_links"], got[i]["component_id"]) == (sum(i in x for x in links), root[i]), i
        assert got[i]["kept"] == (root[i] == i)
    assert crosspolytope.near_vectors(vectors(spark, rows).where("false")).count() == 0


@pytest.mark.parametrize("block_rows", [4096, 9])
def test_nearest_neighbours(spark, block_rows):
    from pyspark.sql import functions as F

    rows = vector_rows()
    got = neighbours.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 10 == 0, 5, block_rows).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    taking = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if usable(v)]
    for i, v in taking:
        if i % 10:
            continue
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True)))), j) for j, w in taking if j != i and len(v) == len(w))[:5]
        assert [(k + 1, j) for k, (_, j) in enumerate(near)] == [x[:2] for x in found.get(i, [])]
        assert np.allclose([s for s, _ in near], [x[2] for x in found.get(i, [])], rtol=1e-12)
    assert neighbours.nearest_neighbours(vectors(spark, rows).where("false"), F.lit(True)).count() == 0
