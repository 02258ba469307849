"""Main text of web pages: boosted trees judge each node of a page, and the tree of nodes is labelled as a whole.

A node's features are its tag, words of its attributes and its ancestors', how dense text, links and tags are below it,
its depth, and how it stands among its siblings. A node is labelled 1 if it holds main text. A node labelled 0 has no
descendant labelled 1: of all labellings that keep to this, the likeliest is chosen, from the leaves up and down again.

There are no labels to learn from, so they are made: text of a bounded sample of the pages is laid out anew in many
ways, with menus, notices, adverts, forms, comments and other furniture around it, and it is known which part is which.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.boosting import Trees, train
from larder.llm.dom import INLINE, OTHER, SPACE, TAG_NUMBER, TAGS, WORDS, Pages

#: Pages whose text training layouts are made of, at most, and layouts made of each.
SAMPLE = 300
LAYOUTS = 6
SEED = 10
PAGES_AT_ONCE = 200

#: Words of class, id and role attributes that furniture and main text go by, whole or as a word's beginning.
FURNITURE = ("nav", "menu", "header", "masthead", "foot", "side", "ad", "ads", "advert", "banner", "promo", "sponsor", "cookie", "notice", "alert",
             "consent", "popup", "modal", "overlay", "comment", "reply", "replies", "discuss", "respond", "form", "search", "share", "social", "related",
             "recommend", "widget", "breadcrumb", "crumb", "subscribe", "newsletter", "signup", "login", "copyright", "legal", "colophon", "tag", "meta",
             "pagination", "pager", "toolbar", "complementary", "contentinfo", "navigation", "warning", "message", "disclaimer", "feedback", "review")
MAIN = ("article", "content", "main", "post", "entry", "story", "body", "text", "prose", "page")
_WHOLE = frozenset(("ad", "ads", "side", "tag", "meta", "form", "page", "text", "body", "nav"))
_GROUPS = {"furniture": tuple(x for x in FURNITURE if x not in ("comment", "reply", "replies", "discuss", "respond", "feedback", "review")),
           "comments": ("comment", "reply", "replies", "discuss", "respond", "feedback", "review"), "main": MAIN}
_FURNITURE_TAGS = np.zeros(OTHER + 1, dtype=bool)
_FURNITURE_TAGS[[TAG_NUMBER[t] for t in ("nav", "header", "footer", "aside", "form", "label")]] = True
_MAIN_TAGS = np.zeros(OTHER + 1, dtype=bool)
_MAIN_TAGS[[TAG_NUMBER[t] for t in ("main", "article")]] = True
_INLINE = np.zeros(OTHER + 1, dtype=bool)
_INLINE[[TAG_NUMBER[t] for t in TAGS if t in INLINE]] = True


def attribute_groups(words: str) -> tuple[bool, bool, bool]:
    """Whether attribute words speak for furniture, for reader comments, for main text."""
    own = WORDS.findall(words)
    hit = lambda names: any(w == n or (n not in _WHOLE and w.startswith(n)) for w in own for n in names)
    return hit(_GROUPS["furniture"]), hit(_GROUPS["comments"]), hit(_GROUPS["main"])


def _below(end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum over each node's subtree; sums of whole numbers, so differences of running sums are exact."""
    total = np.append(0.0, np.cumsum(own.astype(np.float64)))
    return total[end] - total[:-1]


def _above(end: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sum over each node's ancestors, without itself."""
    own = own.astype(np.float64)
    change = np.zeros(len(own) + 1)
    change[1:] += own
    np.subtract.at(change, end, own)
    return np.cumsum(change)[:-1]


def node_features(pages: Pages) -> np.ndarray:
    """A row per feature, a column per node."""
    parent, page, tag, depth, end = pages.arrays()
    n = len(parent)
    up = np.maximum(parent, 0)
    size = np.fromiter((len(t.strip()) for t in pages.text), np.float64, n)
    stops = np.fromiter((t.count(".") + t.count(",") for t in pages.text), np.float64, n)
    known = {w: attribute_groups(w) for w in set(pages.words)}
    groups = np.array([known[w] for w in pages.words], dtype=np.float64).reshape(n, 3)
    is_text = tag == 1
    link = (tag == TAG_NUMBER["a"]).astype(np.float64)
    in_link = _above(end, link) > 0
    text = _below(end, size)
    linked = _below(end, size * in_link)
    tags = _below(end, ~is_text)
    sentences = _below(end, stops)
    whole = np.zeros(int(page.max(initial=0)) + 1)
    np.add.at(whole, page, size)
    siblings = np.zeros(n)
    np.add.at(siblings, up, (parent >= 0) & ~is_text)
    same = np.zeros(n * (OTHER + 1)) if n * (OTHER + 1) < 1 << 22 else None
    key = up * (OTHER + 1) + tag
    if same is not None:
        np.add.at(same, key, 1)
        alike = same[key]
    else:
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        alike = count[back].astype(np.float64)
    place = np.arange(n) - up
    log = np.log1p
    own = [tag.astype(np.float64), is_text, _INLINE[tag], _FURNITURE_TAGS[tag], _MAIN_TAGS[tag], *groups.T,
           _above(end, _FURNITURE_TAGS[tag]), _above(end, _MAIN_TAGS[tag]), *(_above(end, g) for g in groups.T),
           in_link, depth, log(text), linked / np.maximum(text, 1), log(text / np.maximum(tags, 1)), sentences / np.maximum(text / 50, 1), log(tags),
           text / np.maximum(whole[page], 1), text / np.maximum(text[up], 1), siblings[up], alike, log(place)]
    own += [own[0][up], log(text[up]), (linked / np.maximum(text, 1))[up], (sentences / np.maximum(text / 50, 1))[up], groups[up, 0], groups[up, 1]]
    return np.stack([np.asarray(f, dtype=np.float64) for f in own])


def consistent_labels(parent: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The likeliest labels where no node without main text has a descendant with it; roots hold what there is.

    Parents stand before their children, so one pass upwards and one downwards do, however deep the nodes are nested.
    """
    no, yes = np.log(np.clip(1 - p, 1e-9, 1)).tolist(), np.log(np.clip(p, 1e-9, 1)).tolist()
    up = parent.tolist()
    for k in range(len(up) - 1, -1, -1):
        if (a := up[k]) >= 0:
            yes[a] += max(no[k], yes[k])
            no[a] += no[k]
    label = [True] * len(up)
    for k, a in enumerate(up):
        if a >= 0:
            label[k] = label[a] and yes[k] >= no[k]
    return np.array(label, dtype=bool)


def main_texts(html: list[str], trees: Trees) -> list[str]:
    """Main text of each page: its blocks in page order, an empty line between them."""
    pages = Pages(html)
    parent, page, tag, _, _ = pages.arrays()
    label = consistent_labels(parent, trees.probabilities(node_features(pages)))
    out: list[list[list[str]]] = [[] for _ in html]
    last = None
    for k in np.flatnonzero(label & (tag == 1)).tolist():
        own = out[page[k]]
        if pages.block[k] == last:
            own[-1].append(pages.text[k])
        else:
            own.append([pages.text[k]])
            last = pages.block[k]
    return ["\n\n".join(b for b in (SPACE.sub(" ", "".join(x)).strip() for x in own) if b) for own in out]


class Layouts:
    """Pages laid out anew. Main text is marked by a sign that is taken out again when the page is read."""

    MARK = "\ue000"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def _attribute(self, *names: str) -> str:
        name = self.rng.choice(names)
        if self.rng.random() < 0.4:
            name += self.rng.choice(("-1", "-wrapper", "_box", " clearfix", "-inner", "-area", " col-8"))
        return self.rng.choice((f' class="{name}"', f' id="{name}"', f" class='{name}'"))

    def _short(self, texts: list[str], most: int = 12) -> str:
        words = self.rng.choice(texts).split()
        at = self.rng.randrange(max(1, len(words)))
        return escape(" ".join(words[at : at + self.rng.randrange(1, most)]) or "more")

    def _links(self, texts: list[str]) -> str:
        items = [f'<a href="/x">{self._short(texts, 5)}</a>' for _ in range(self.rng.randrange(2, 9))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.rng.random() < 0.6 else " | ".join(items)

    def furniture(self, texts: list[str]) -> str:
        """A piece of a page that is not main text, of a random kind."""
        r, long_ = self.rng, escape(self.rng.choice(texts))
        heading = f"<h{r.randrange(2, 5)}>{self._short(texts, 6)}</h{r.randrange(2, 5)}>" if r.random() < 0.5 else ""
        paragraph = f"<p>{r.choice((self._short(texts, 30), long_))}</p>"
        kind = r.randrange(9)
        if kind == 0:
            return r.choice((f"<nav>{self._links(texts)}</nav>", f"<div{self._attribute('nav', 'menu', 'navbar', 'breadcrumbs', 'main-menu')}>{self._links(texts)}</div>",
                             f'<div role="navigation">{self._links(texts)}</div>', f"<ul{self._attribute('menu', 'nav-list', 'pagination')}><li><a href='/'>{self._short(texts, 4)}</a></li></ul>"))
        if kind == 1:
            return r.choice((f"<header>{heading}{self._links(texts)}</header>", f"<header><p>{self._short(texts)}</p></header>",
                             f"<div{self._attribute('header', 'masthead', 'site-header', 'topbar')}>{heading}<p>{self._short(texts)}</p></div>"))
        if kind == 2:
            return r.choice((f"<aside>{heading}{paragraph}{self._links(texts)}</aside>", f"<aside{self._attribute('box', 'col', 'sidebar')}>{paragraph}</aside>",
                             f"<div{self._attribute('sidebar', 'side', 'related', 'widget', 'recommended')}>{heading}{paragraph}{self._links(texts)}</div>"))
        if kind == 3:
            return f"<div{self._attribute('cookie-notice', 'alert', 'notice', 'consent', 'popup', 'banner', 'warning', 'site-message')}>{r.choice((paragraph, self._short(texts, 30)))}<button>{self._short(texts, 3)}</button></div>"
        if kind == 4:
            return f"<{(t := r.choice(('div', 'section', 'aside')))}{self._attribute('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot', 'advertisement')}>{r.choice((long_, self._short(texts, 20), paragraph))}</{t}>"
        if kind == 5:
            return f"<form{r.choice(('', self._attribute('search', 'newsletter', 'login')))}>{r.choice(('', paragraph))}<label>{self._short(texts, 5)}</label><input name=q><button>{self._short(texts, 3)}</button></form>"
        if kind == 6:
            comments = "".join(f"<{t}{self._attribute('comment', 'comment-body', 'reply')}><p>{r.choice((long_, self._short(texts, 40)))}</p></{t}>"
                               for t in (r.choice(("div", "li", "article")) for _ in range(r.randrange(1, 5))))
            return r.choice((f"<section{self._attribute('comments', 'discussion', 'responses')}>{heading}{comments}</section>", f"<div{self._attribute('comments', 'comment-list', 'disqus_comments', 'replies')}>{heading}{comments}</div>",
                             f"<ol{self._attribute('comments', 'commentlist')}>{comments}</ol>"))
        if kind == 7:
            return f"<div{self._attribute('share', 'social', 'subscribe', 'newsletter', 'related-posts', 'post-meta', 'tags')}>{heading}{r.choice((self._links(texts), paragraph))}</div>"
        return r.choice((f"<footer>{self._short(texts, 20)}</footer>", f"<footer><p>&copy; {long_}</p>{self._links(texts)}</footer>",
                         f"<div{self._attribute('footer', 'colophon', 'site-footer', 'copyright', 'legal')}><p>{self._short(texts, 20)}</p></div>"))

    def page(self, own: list[str], texts: list[str]) -> str:
        """``own`` as main text, in a random layout; an empty list gives a page without any."""
        r, mark = self.rng, self.MARK
        parts = [f"<h{r.choice('1123')}>{mark}{escape(own[0][:60])}</h1>" if own and r.random() < 0.7 else ""]
        plain = r.random() < 0.1  # text in a container without any markup of its own
        for k, x in enumerate(own):
            text, kind = mark + escape(x), r.random()
            if kind < 0.08:
                cut = len(x) // 2
                text = f'{mark}{escape(x[:cut])}<a href="/y">{mark}{escape(x[cut : cut + 12])}</a>{mark}{escape(x[cut + 12 :])}'
            elif kind < 0.14:
                text = f"<b>{text}" + r.choice(("</b>", "<br>", ""))
            wrap = r.random()
            if plain:
                parts.append(text + "<br><br>")
            elif wrap < 0.75:
                parts.append(f"<p>{text}" + r.choice(("</p>", "</p>\n", "</p>", "")))
            elif wrap < 0.8:
                parts.append(f"<blockquote><p>{text}</p></blockquote>")
            elif wrap < 0.87:
                parts.append(f"<ul><li>{text}</li><li>{mark}{self._short(texts, 15)}</li></ul>")
            elif wrap < 0.91:
                parts.append(f"<h2>{mark}{self._short(texts, 6)}</h2><p>{text}</p>")
            elif wrap < 0.94:
                parts.append(f"<table><tr><td>{text}</td><td>{mark}{self._short(texts, 6)}</td></tr></table>")
            else:
                parts.append(f"<div>{text}</div>")
            if k and r.random() < 0.05:
                parts.append(self.furniture(texts))
        body = "".join(parts)
        for _ in range(r.randrange(0, 3)):
            if r.random() < 0.25:
                body += self.furniture(texts)
            body = r.choice((f"<div>{body}</div>", f"<section>{body}</section>", f"<div{self._attribute('entry', 'text', 'post-body', 'inner', 'row')}>{body}</div>"))
        body = r.choice((f"<article>{body}</article>", f"<article{self._attribute('post', 'story', 'hentry')}>{body}</article>", f"<main>{body}</main>",
                         f"<div{self._attribute('content', 'article', 'post', 'entry-content', 'story', 'main')}>{body}</div>", f"<div>{body}</div>",
                         f"<main><article>{body}</article></main>", f'<div role="main">{body}</div>'))
        before = "".join(self.furniture(texts) for _ in range(r.randrange(0, 5)))
        after = "".join(self.furniture(texts) for _ in range(r.randrange(0, 5)))
        whole = before + body + after
        for _ in range(r.randrange(0, 3)):
            whole = f"<div{r.choice(('', self._attribute('wrapper', 'container', 'page', 'layout')))}>{whole}</div>"
        return f"<!DOCTYPE html><html><head><title>{self._short(texts)}</title><style>p{{}}</style></head><body>{whole}</body></html>"


def fit_trees(sample: list[str], layouts: int = LAYOUTS, seed: int = SEED) -> Trees:
    """Trees trained on layouts of the sample's paragraphs."""
    rough = Pages(sample)
    found: list[list[str]] = [[] for _ in sample]
    for page, tag, text in zip(rough.page, rough.tag, rough.text, strict=True):
        if tag == 1 and len(text.strip()) >= 40:
            found[page].append(SPACE.sub(" ", text).strip())
    found = [f for f in found if f] or [["Some words, with a stop at the end of them."]]
    maker = Layouts(seed)
    texts = [x for f in found for x in f]
    made = []
    for own in found:
        for _ in range(layouts):
            kind, start = maker.rng.random(), maker.rng.randrange(len(own))
            pick = [] if kind < 0.03 else own[start : start + 2] if kind < 0.2 else own[:40]
            made.append(maker.page([x.replace(Layouts.MARK, " ") for x in pick], texts))
    pages = Pages(made)
    _, _, tag, _, end = pages.arrays()
    held = np.fromiter((Layouts.MARK in t for t in pages.text), np.float64, len(tag))
    pages.text = [t.replace(Layouts.MARK, "") for t in pages.text]
    label = (_below(end, held) > 0).astype(np.float64)
    size = np.fromiter((len(t) for t in pages.text), np.float64, len(tag))
    weight = 1 + 0.5 * np.log1p(_below(end, size))
    return train(node_features(pages), label, weight)


def sample_pages(pages: DataFrame, sample: int = SAMPLE) -> list[str]:
    """At most ``sample`` different pages, the same ones however rows are stored."""
    total = max(1, pages.count())
    order = F.xxhash64(F.lit(SEED), "html")
    drawn = pages.where("html is not null").withColumn("order", order)
    drawn = drawn.where(F.pmod("order", F.lit(1 << 30)) < int(min(1.0, 4 * sample / total) * (1 << 30)) + (4 * sample >= total))
    return [r["html"] for r in drawn.groupBy("order").agg(F.first("html").alias("html")).orderBy("order").limit(sample).collect()]


def extract_text(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row; a page without main text, an empty or null one too, has an empty text.

    Rows are independent, so rows that repeat agree. Other columns are ignored. A page of any length or nesting is read in one
    pass; a tag whose quote is never closed ends at the next bracket.
    """
    rows = pages.select("page_id", "url", "html")
    trees = pages.sparkSession.sparkContext.broadcast(fit_trees(sample_pages(rows, sample)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(k, PAGES_AT_ONCE)
                texts = main_texts([h or "" for h in batch.column(2).to_pylist()], trees.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
