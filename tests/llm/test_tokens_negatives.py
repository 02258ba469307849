"""Byte-level BPE, vocabulary alignment and hard negatives against the libraries and brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers as P

from larder.llm import bytebpe, crosstoken, negatives
from larder.llm.perfecthash import KeyedCounts, PerfectHash
from larder.llm.units import units
from tests.llm.data import documents, messy_texts

RANKS, FIRST, SECOND = (P.path(x) for x in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["  a  b\n\tc  ", " ", "\n \n x", "a ", " a", "x  y " * 5 + " " * 20, "中文字 x 中 文", "<|endoftext|> <s> </s><0x41> <|endoftext|>",
       "a　b\x00c ﬁ \x1c z\x1f y", "▁x y▁ z", "՘x ࢏1 \U0001e6c0 a😀 b", "'s 're don't  I'll we've", "1234 56a7 ½", "é" * 400, "q" * 3000, "-=" * 900 + " =-"]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 62, n))
        made = PerfectHash(keys)
        assert sorted(made.numbers(keys).tolist()) == list(range(len(keys)))
    counts = KeyedCounts(keys, np.arange(len(keys)))
    counts.add(keys[:10], np.full(10, 5))
    assert counts.get(keys).tolist() == [k + 5 * (k < 10) for k in range(len(keys))]
    assert not counts.get(keys + 1)[~np.isin(keys + 1, keys)].any()  # keys that were never put in
    with pytest.raises(KeyError):
        counts.add(np.array([1 << 62]), np.array([1]))
    with pytest.raises(ValueError):
        PerfectHash(np.array([3, 3]))


def test_units_are_the_text():
    for text in messy_texts() + ODD:
        assert text is None or " ".join(units(text)) == text


def tiktoken_ids(texts: list) -> list[list[int]]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}  # noqa: SIM115
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch([t or "" for t in texts])


def test_byte_bpe(spark, monkeypatch):
    texts = messy_texts() + ODD + ["word " * 200_000 + "end"]  # the last one is longer than a batch
    ids = [*range(len(texts) - 2), None, 9007199254740993]
    docs = documents(spark, texts, ids)
    want = Counter((i, len(t), hashlib.sha256(np.array(t, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest())
                   for i, t, x in zip(ids, tiktoken_ids(texts), texts, strict=True))
    assert Counter(map(tuple, bytebpe.token_digests(docs, RANKS, P.PATTERN).collect())) == want
    small = docs.where("length(text) < 100000 or text is null")
    encoded = bytebpe.encode_texts(small, RANKS, P.PATTERN)
    own = {i: t for i, t in zip(ids, tiktoken_ids(texts), strict=True)}
    assert all(r["ids"] == own[r["doc_id"]] for r in encoded.collect())
    back = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bytebpe.decode_ids(encoded, RANKS, P.PATTERN).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in small.collect()}
    assert bytebpe.token_digests(docs.where("false"), RANKS, P.PATTERN).collect() == []


def test_units_are_forgotten(monkeypatch):
    monkeypatch.setattr(bytebpe, "UNITS", 5)
    bpe = bytebpe.ByteBpe(bytebpe.read_ranks(RANKS), P.PATTERN, bytebpe.newer_signs())
    texts = [t or "" for t in messy_texts() + ODD]
    found = []
    for t in texts:
        ids, bounds = bpe.encode([t, ""])
        assert bounds.tolist() == [0, len(ids), len(ids)]
        found.append(ids.tolist())
    assert found == tiktoken_ids(texts)


def test_new_units_are_split_as_one_text(monkeypatch):
    """Splitting and merging cost a call per batch and new match, not one per unit."""
    bpe = bytebpe.ByteBpe(bytebpe.read_ranks(RANKS), P.PATTERN, bytebpe.newer_signs())
    split, merged = [], []
    merge = bytebpe.merge_bytes
    monkeypatch.setattr(bpe, "split", lambda text: split.append(text) or bytebpe.ByteBpe.split(bpe, text))
    monkeypatch.setattr(bytebpe, "merge_bytes", lambda word, *a: merged.append(word) or merge(word, *a))
    words = [f"{'zqx' * (k % 5)}{chr(97 + k % 26)}{chr(97 + k // 26)}vwk" for k in range(600)]
    texts = [" ".join(words), " ".join(w + "," for w in words[1:]), "zq\n", " ".join(w + ".\nEnd" for w in words), " x  y\t z"]
    ids, bounds = bpe.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == tiktoken_ids(texts)  # noqa: B905
    assert len(split) < 12 and len(merged) == len(set(merged))
    assert [bpe.decode(ids[a:b]).decode() for a, b in zip(bounds, bounds[1:])] == texts  # noqa: B905
    for wrong in (-1, 1 << 20):
        with pytest.raises(KeyError):
            bpe.decode(np.array([wrong]))


@pytest.mark.parametrize("word", [b"a", b"ab", b"aaaaaaaaaaaaaaaa", b"\xff\xfe\x00\xff", " thethethe".encode() * 9, "éàé".encode() * 50])
def test_merges_are_those_of_a_scan(word):
    """The heap merges what a scan for the least rank, leftmost first, merges."""
    bpe = bytebpe.ByteBpe(bytebpe.read_ranks(RANKS), P.PATTERN)
    parts = [word[k : k + 1] for k in range(len(word))]
    while (best := min(((bpe.ranks.get(a + b, 1 << 30), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0)))[0] < 1 << 30:  # noqa: B905
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    ids, size = bpe.words([word, b"q", word])
    want = [bpe.ranks[p] for p in parts]
    assert ids.tolist() == [*want, bpe.ranks[b"q"], *want] and size.tolist() == [len(want), 1, len(want)]


def aligned(texts: list) -> list[tuple]:
    """Whole texts through both libraries, pair by pair."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    a_lib.encode_special_tokens = True
    by_id = {i: b for b, i in bytebpe.read_ranks(RANKS).items()}  # the same vocabulary
    b_bytes = lambda k: bytes([int(b_lib.id_to_piece(k)[3:-1], 16)]) if b_lib.is_byte(k) else b_lib.id_to_piece(k).replace("▁", " ").encode()
    found, count = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        if not text or b"".join(map(by_id.get, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            found.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(by_id[k]) for k in a]).tolist(), np.cumsum([len(b_bytes(k)) for k in b]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        groups = [([], []) for _ in common]
        for side, (ids, ends) in enumerate(((a, ends_a), (b, ends_b))):
            for k, e in zip(ids, ends, strict=True):
                groups[next(g for g, c in enumerate(common) if c >= e)][side].append(k)
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        found.append((len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("limits", [{}, {"shards": 3, "fan": 2, "hold": 50, "round_bytes": 2000}])
def test_align_vocabularies(spark, limits, monkeypatch):
    """One round and several, tasks that send their pairs in parts, and groups in blocks give the same rows."""
    if limits:
        monkeypatch.setattr(crosstoken, "BLOCK_LINKS", 7)  # for the tables of this process
    texts = messy_texts() + ODD
    ids = [*range(len(texts) - 2), None, 9007199254740993]
    docs = documents(spark, texts, ids)
    rows = crosstoken.align_vocabularies(docs, FIRST, SECOND, **limits).collect()
    assert Counter(map(tuple, rows)) == Counter((i, *x) for i, x in zip(ids, aligned(texts), strict=True))


def test_align_blocks(monkeypatch):
    whole = crosstoken.TwoVocabularies(FIRST, SECOND)
    monkeypatch.setattr(crosstoken, "BLOCK_LINKS", 3)
    monkeypatch.setattr(crosstoken, "UNITS_AT_ONCE", 2)
    parts = crosstoken.TwoVocabularies(FIRST, SECOND)
    for text in ODD:
        (a, _), (b, _) = whole.read([text]), parts.read([text])
        assert whole.sizes[:5][:, a].tolist() == parts.sizes[:5][:, b].tolist()
        assert [x.tolist() for x in whole.linked(a)] == [x.tolist() for x in parts.linked(b)]
        assert [whole.groups[k] for k in a] == [parts.groups[k] for k in b]


def test_align_nothing(spark):
    docs = documents(spark, [None, "", "▁"])
    for d, n in ((docs, 3), (docs.where("false"), 0)):
        assert [tuple(r)[1:] for r in crosstoken.align_vocabularies(d, FIRST, SECOND).collect()] == [(0, 0, 0, 0, 0, 0, "")] * n


VECTORS = "vec_id long, embedding array<float>, label int, block int, kind string, tile string, score double"


def vector_rows(n: int = 260) -> list[tuple]:
    rng = random.Random(4)
    rows = []
    for k in range(n):
        v = [rng.gauss(0, 1) for _ in range(6)]
        if k % 3 == 0:  # a third of all rows has one label and lies together
            v = [1 + x / 8 for x in v]
        if k % 29 == 5:
            v = v[:4]
        rows.append([k, v, 2 if k % 3 == 0 else k % 5])
    rows[11][1], rows[12][1][2], rows[13][1][0], rows[14][2], rows[15][1] = None, None, float("nan"), None, [float("inf")] * 6
    rows[20][1] = [0.0] * 6  # a zero vector takes part
    rows[30][1], rows[40][1] = list(rows[50][1]), list(rows[50][1])  # ties
    rows[60][1] = []
    rows += [[None, [1.0] * 6, 2], list(rows[70]), list(rows[70]), [-10, [0.5] * 6, 2], [1 << 60, [0.5] * 6, 1]]
    return [(*r, 1, "x", "y", 0.0) for r in rows]


def mined(rows: list[tuple], anchor, scale: int = 256) -> set[tuple]:
    own = {}
    for i, v, label, *_ in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            own[i] = ([math.floor(scale * float(np.float32(x))) for x in v], label)
    out = set()
    for i, (v, label) in own.items():
        if not anchor(i):
            continue
        scored = sorted((-sum(map(int.__mul__, v, w)), j) for j, (w, _) in own.items() if j != i and len(w) == len(v))
        for p, j in [x for x in scored if own[x[1]][1] == label][:5]:
            near = [x for x in scored if own[x[1]][1] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out |= {(i, j, rank, k, -p, -s) for rank, (s, k) in enumerate(near, 1)}
    return out


@pytest.mark.parametrize("limits", [{}, {"block_rows": 30, "tile_anchors": 7}])
def test_hard_negatives(spark, limits):
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = negatives.mine_negatives(frame, frame.vec_id % 5 == 0, **limits).collect()
    want = mined(rows, lambda i: math.fmod(i, 5) == 0)
    assert len(found) == len(want) > 100
    assert set(map(tuple, found)) == want
    assert negatives.mine_negatives(frame.where("false"), frame.vec_id % 5 == 0).collect() == []
    assert negatives.mine_negatives(frame.where("embedding is null"), frame.vec_id % 5 == 0).collect() == []


def test_far_scores(spark):
    """Components whose products no double holds as whole numbers; a score beyond a long is that range's end."""
    rng = random.Random(5)
    rows = [(k, [rng.choice((3e6, -3e6, 1e6, 1.5)) * rng.random() for _ in range(5)], k % 2, 1, "x", "y", 0.0) for k in range(40)]
    rows += [(100, [3e38] * 5, 0, 1, "x", "y", 0.0), (101, [-3e38] * 5, 0, 1, "x", "y", 0.0), (102, [3e38, 1.0, 1.0, 1.0, 1.0], 1, 1, "x", "y", 0.0)]
    frame = spark.createDataFrame(rows, VECTORS)
    found = set(map(tuple, negatives.mine_negatives(frame.where("vec_id < 100"), frame.vec_id % 5 == 0).collect()))
    assert found == mined(rows[:40], lambda i: i % 5 == 0)
    most = (1 << 63) - 1
    assert all(abs(x) <= most + 1 for r in negatives.mine_negatives(frame, frame.vec_id % 5 == 0).collect() for x in (r.positive_score, r.negative_score))


def test_bounds_spare_rows():
    """Rows near an anchor's parent whose bounds leave the window are not scored again, and no bound is wrong."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 16)) * 500
    codes = np.floor(centre[rng.integers(0, 6, 400)] + rng.normal(size=(400, 16)) * 3)
    labels = np.arange(400) % 3
    rows = negatives.Rows(np.arange(400), labels, codes)
    anchors = negatives.Rows(np.arange(30), labels[:30], codes[:30])
    walk = negatives.Walk(anchors, rows, negatives.spanning_tree(codes[:30]))
    exact = codes[:30] @ codes.T
    for a, low, high in walk:
        assert (low <= exact[a]).all() and (exact[a] <= high).all()
        walk.exact(a, np.flatnonzero(high >= np.sort(low)[-5]))
    assert walk.scored < 30 * 400 / 2


class Counted:
    """A tokenizer that notes how many texts it is given; with ``wrong`` its first answer is wrong."""

    def __init__(self, own, wrong: bool = False):
        self.own, self.given, self.wrong = own, [], wrong

    def encode_batch_fast(self, texts, **options):
        self.given.append(len(texts))
        found = self.own.encode_batch_fast(texts, **options)
        return list(reversed(found)) if self.wrong and len(self.given) == 1 else found


def test_units_are_encoded_in_rows():
    """The first tokenizer gets rows of new units, which end where the units do; if they don't, it gets them one by one."""
    each, rows, wrong = (crosstoken.TwoVocabularies(FIRST, SECOND) for _ in range(3))
    rows.a, wrong.a = Counted(rows.a), Counted(wrong.a, wrong=True)
    texts = [t for t in messy_texts() if t and "\x00" not in t and "ﬁ" not in t][:40] + [t for t in ODD if "  " not in t]
    fresh = [u for u in dict.fromkeys(u for t in texts for u in units(t)) if u]
    want = each._first_ids([" " + u for u in fresh])
    size = lambda us: np.array([len(u.encode()) + 1 for u in us])
    for table in (rows, wrong):
        ids, n = table._first_of_units(fresh, size(fresh))
        assert ids.tolist() == want[0].tolist() and n.tolist() == want[1].tolist()
    alone = sum(" " in u or u != u.strip() for u in fresh)
    assert 0 < alone < len(fresh) // 2 and sum(rows.a.given) <= alone + len(fresh) // crosstoken.JOINED + 1
    assert sum(wrong.a.given) > len(fresh)
    for lone in ([" "], ["a"], ["a b", "\n"]):
        assert [x.tolist() for x in rows._first_of_units(lone, size(lone))] == [x.tolist() for x in each._first_ids([" " + u for u in lone])]


def test_units_are_dropped_where_pairs_are_added_up():
    """A worker that has aligned texts holds none of their units while it adds up tables of pairs."""
    table = crosstoken.vocabularies(FIRST, SECOND)
    for run in (crosstoken._unite(False), crosstoken._unite(True), crosstoken._add_up, crosstoken._sum_branches(table.width)):
        table.read(["some words of a text"])
        assert len(table.known) and table.held
        assert list(run(iter([]))) == [] and not len(table.known) and not table.held
    code, bounds = table.read(["some words of a text"])
    assert len(code) == bounds[-1] == 5 and table.clean(code, bounds).all()


def test_groups_are_written_where_they_are_read():
    """Counting pairs writes no groups; a table that counted gives the same units again with theirs."""
    once, again = crosstoken.TwoVocabularies(FIRST, SECOND), crosstoken.TwoVocabularies(FIRST, SECOND)
    texts = [t for t in messy_texts() + ODD if t]
    again.write(False)
    again.read(texts)
    assert set(again.groups) == {b""} and again.held
    again.write(True)
    found = [(t.read(texts)[0].tolist(), t.groups, t.keys[: t.held].tolist(), t.sizes[:, : len(t.known)].tolist()) for t in (once, again)]
    assert found[0] == found[1] and any(found[0][1])
