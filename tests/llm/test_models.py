"""Language, quality and page text: held-out accuracy and the cases that need no model."""

from __future__ import annotations

import random
import re
import time
import zlib

import numpy as np

from larder.llm import htmltext, langid, quality
from larder.llm.dom import Pages
from tests.llm.data import documents, words

SF = "/root/testdata/sf0.01"


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = langid.predict_language(docs).collect()
    assert len(rows) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_without_letters(spark):
    docs = documents(spark, [None, "", "12 34 !", "hello world"], [1, 2, None, 4])
    got = langid.predict_language(docs.withColumn("lang", docs.lang)).collect()
    assert {str(r["doc_id"]): r["lang_pred"] for r in got} == {"1": "und", "2": "und", "None": "und", "4": "en"}
    assert langid.predict_language(docs.where("false")).count() == 0
    unknown = langid.predict_language(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def test_gram_counts_are_those_of_a_loop():
    from larder.llm.textbuf import Chunk

    texts = ["Ab  é, x", "", "ß"]
    raw = [t.encode() for t in texts]
    chunk = Chunk(0, np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))
    got = list(langid.gram_counts(chunk.data, chunk.bounds))
    assert got[1] is None
    for text, counts in zip(texts, got, strict=True):
        if counts is not None:
            plain = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
            assert counts.sum() == sum(max(0, len(plain) - n + 1) for n in langid.ORDERS)


def test_quality_agrees_with_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in quality.score_documents(docs).collect()}
    assert len(got) == docs.count()
    good = [got[i]["kept"] for i, q in labels.items() if q == 1]
    bad = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_label_model_finds_labellers():
    """Made votes: labellers that rarely blame a good text, each of which knows one way to be bad, and one that abstains."""
    rng = np.random.default_rng(1)
    made, patterns = [], {}
    for _ in range(8000):
        bad = int(rng.integers(4)) if rng.random() < 0.2 else None
        blame = [0.005 if bad is None else 0.95 if k == bad else 0.1 for k in range(4)]
        votes = [2 if rng.random() < x else 1 for x in blame] + [0] * (len(quality.LABELLERS) - 4)
        p = sum(v * 3**k for k, v in enumerate(votes))
        patterns[p] = patterns.get(p, 0) + 1
        made.append((votes, bad is None))
    share, table = quality.label_model(patterns)
    assert abs(share[0] - 0.8) < 0.05
    assert (table[0, :4, 2] < 0.06).all() and (table[np.arange(1, 5), np.arange(4), 2] > 0.5).all()
    good = quality.posteriors(share, table, np.array([v for v, _ in made])) > 0.5
    assert np.mean(good == np.array([g for _, g in made])) > 0.95


def test_quality_edges(spark):
    docs = documents(spark, [None, "", " ", words(random.Random(1), 60)] * 2, [1, 2, 3, 4, 1, 2, 3, None])
    got = quality.score_documents(docs).collect()
    assert len(got) == 8 and all(not r["kept"] for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.score_documents(docs.where("false")).count() == 0
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert quality.good_documents(docs, columns).columns == columns


def test_pages(spark):
    """The whole article of every page of the test tables, and nothing else."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for page, got in zip(pages.orderBy("page_id").collect(), htmltext.extract_text(pages).orderBy("page_id").collect(), strict=True):
        article = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", htmltext.Pages([b]).text and "".join(Pages([b]).text) or "").strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert got["text"] == "\n\n".join(b for b in blocks if b)
        assert got["n_chars"] == len(got["text"])


def test_layouts_never_trained_on(spark):
    pages = [r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]
    trees = htmltext.fit_trees(pages[:60], layouts=5)
    texts = [b for t in htmltext.main_texts(pages[100:130], trees) for b in t.split("\n\n") if len(b) > 40]
    maker, right, wrong = htmltext.Layouts(77), 0, 0
    for k in range(100):
        made = maker.page(texts[k : k + 3], texts)
        held = ["".join(t.split()) for t in Pages([made]).text if maker.MARK in t]
        got = "".join(htmltext.main_texts([made.replace(maker.MARK, "")], trees)[0].split())
        want = "".join(held).replace(maker.MARK, "")
        right += len(want) and got == want
        wrong += abs(len(got) - len(want)) > 0.5 * len(want)
    assert right > 75 and wrong < 10


def test_page_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (3, "u", "<p", "z"), (3, "u", "<p", "z"), (4, "u", "plain &am", "z")]
    got = htmltext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r["page_id"] for r in got) == [1, 2, 3, 3, 4]
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] < 4)
    assert htmltext.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_labels_never_contradict():
    rng = np.random.default_rng(3)
    parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, 60)])
    label = htmltext.consistent_labels(parent, rng.random(60))
    assert all(label[parent[k]] for k in range(1, 60) if label[k])
    small = np.array([-1, 0, 1, 1])
    assert htmltext.consistent_labels(small, np.array([0.9, 0.3, 0.9, 0.2])).tolist() == [True, True, True, False]


def test_labels_are_the_likeliest_of_all():
    """Every labelling without contradictions of small trees."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        parent = np.array([-1] + [int(rng.integers(0, k)) for k in range(1, n)])
        p = rng.random(n)
        best = (-np.inf, None)
        for bits in range(1 << (n - 1)):
            label = [True] + [bool(bits >> k & 1) for k in range(n - 1)]
            if all(label[parent[k]] or not label[k] for k in range(1, n)):
                score = sum(np.log(p[k] if label[k] else 1 - p[k]) for k in range(1, n))
                best = max(best, (score, label), key=lambda x: x[0])
        assert htmltext.consistent_labels(parent, p).tolist() == best[1]


def test_broken_and_deep_pages():
    """Pages that a search from each tag on, or a scan per level, would take minutes or hours for."""
    words = "Some words of the text, with a stop at the end of them. " * 4
    trees = htmltext.fit_trees([f"<html><body><article><p>{words}</p><p>{words}</p></article></body></html>"])
    hostile = ["<a " * 600_000 + '"' + "x" * 3_000_000, "<a \"" * 300_000, "<div>" * 100_000 + "x" + "</div>" * 100_000,
               "<i>" * 50_000 + "<p>x</p>" * 50_000, "<div>" * 50_000 + "<li>" * 50_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
               "<p>" + "x<b>y</b>" * 100_000]
    for page in hostile:
        start = time.time()
        htmltext.main_texts([page], trees)
        assert time.time() - start < 10
    open_quote = f'<article><p class="x>{words}</p><p>{words}</p></article>'
    assert words.strip() in htmltext.main_texts([open_quote], trees)[0]
    page = f"<article><p>{words}</p><noscript><p>{words}</p></noscript><p>{words}<math><mi>abc</mi></math></p><svg><text>def</text></svg></article>"
    text = "".join(Pages([page]).text)
    assert text.count("Some words") == 12 and "abc" in text and "def" in text
    assert Pages(["", "<noscript><p>left open"]).text[-1] == "left open"


def test_pages_of_nothing(spark):
    rows = spark.createDataFrame([(1, "u", None), (2, None, None), (None, "u", "")], "page_id long, url string, html string")
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in htmltext.extract_text(rows).collect()) == [("1", "", 0), ("2", "", 0), ("None", "", 0)]
