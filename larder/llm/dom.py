"""A forgiving reader of HTML: nodes of many pages in one set of arrays, parents before children."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from html import unescape

import numpy as np

OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page; what a page shows only at times is for the trees to judge.
SILENT = frozenset("script style head title template button select textarea datalist".split())
RAW = frozenset(("script", "style", "title", "textarea"))
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: What an opening tag closes first: the tags, and those at which the search for them ends.
_CELLS = frozenset(("td", "th"))
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))), "option": (frozenset(("option",)), frozenset(("select",))),
    "tr": (frozenset(("tr", *_CELLS)), frozenset(("table",))), "td": (_CELLS, frozenset(("tr", "table"))), "th": (_CELLS, frozenset(("tr", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
}
TAGS = ("#page", "#text", "html", "body", "main", "article", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "a", "nav", "header",
        "footer", "aside", "form", "table", "tr", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dt", "dd", "label", "span", "b", "details")
TAG_NUMBER = {t: k for k, t in enumerate(TAGS)}
OTHER = len(TAGS)


class Pages:
    """Nodes of pages: ``parent`` and ``page`` of each, its tag's number, attribute words and, of text nodes, the text.

    ``block`` numbers the blocks that text nodes belong to: a block ends where an element that is not inline begins or
    ends."""

    def __init__(self, pages: list[str]):
        self.parent: list[int] = []
        self.page: list[int] = []
        self.tag: list[int] = []
        self.words: list[str] = []
        self.text: list[str] = []
        self.block: list[int] = []
        self.blocks = 0
        for k, page in enumerate(pages):
            self._read(k, page)

    def _node(self, parent: int, page: int, tag: int, words: str = "", text: str = "") -> int:
        self.parent.append(parent)
        self.page.append(page)
        self.tag.append(tag)
        self.words.append(words)
        self.text.append(text)
        self.block.append(self.blocks)
        return len(self.parent) - 1

    @staticmethod
    def _closed_by(name: str, names: list[str], opened: dict[str, list[int]], blocks: list[int], pop: Callable[[], None]) -> None:
        """Closes what the opening tag of ``name`` ends."""
        if name in INLINE or name in VOID:
            return
        low = len(names)
        if ends := CLOSES.get(name):
            edge = max((opened[n][-1] for n in ends[1] if opened.get(n)), default=0)
            for n in ("p", *ends[0]):
                own = opened.get(n, ())
                k = bisect_right(own, edge)
                if k < len(own):
                    low = min(low, own[k])
        elif names[blocks[-1]] == "p":
            low = blocks[-1]
        while len(names) > low:
            pop()
        if name == "body" and opened.get("head"):
            while opened["head"]:
                pop()

    def _read(self, page: int, html: str) -> None:
        """One forward reading: what is looked at again is bounded, however a page is broken or nested."""
        self.blocks += 1
        names, nodes, silent = ["#page"], [self._node(-1, page, 0)], 0
        opened: dict[str, list[int]] = {}  # places in names
        blocks = [0]  # those that are not inline
        at, size = 0, len(html)
        last = {q: html.rfind(q) for q in "\"'"}

        def text(a: int, b: int) -> None:
            if a < b and not silent:
                x = html[a:b]
                if "&" in x:
                    x = unescape(x)
                self._node(nodes[-1], page, 1, "", x)

        def pop() -> None:
            nonlocal silent
            name = names.pop()
            nodes.pop()
            opened[name].pop()
            silent -= name in SILENT
            if name not in INLINE:
                blocks.pop()
                self.blocks += 1

        def end_of_tag(k: int) -> int:
            """Where the tag's attributes end; a quote that is never closed ends at the next bracket."""
            while True:
                k = PLAIN.match(html, k).end()
                if k >= size or html[k] == ">":
                    return k
                k = html.find(html[k], k + 1) + 1 if last[html[k]] > k else (html.find(">", k) + 1 or size + 1) - 1

        def past(sign: str, k: int) -> int:
            found = html.find(sign, k)
            return found + len(sign) if found >= 0 else size

        start = html.find("<")
        while start >= 0:
            found = OPENING.match(html, start)
            if found is None:
                after = html[start + 1 : start + 2]
                if after and after in "!?":
                    text(at, start)
                    at = past("-->", start + 4) if html.startswith("<!--", start) else past(">", start)
                    start = html.find("<", at)
                    continue
                following = html.find("<", start + 1)
                if after == "/" and following < 0:
                    text(at, start)
                    at = size
                start = following
                continue
            text(at, start)
            close = end_of_tag(found.end())
            attributes, at = html[found.end() : close], min(close + 1, size)
            name = found[2].lower()
            if found[1]:
                own = opened.get(name)
                if own:  # an inline end tag does not close the block around it
                    low = own[-1]
                    if name not in INLINE or blocks[-1] < low:
                        while len(names) > low:
                            pop()
                elif name in ("p", "br"):
                    self.blocks += name == "p"
            elif name == "br":
                if not silent:
                    self._node(nodes[-1], page, 1, "", " ")
            elif name in VOID:
                self.blocks += name == "hr"
            else:
                self._closed_by(name, names, opened, blocks, pop)
                words = ""
                if "=" in attributes:
                    words = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes)).lower()
                if name not in INLINE:
                    self.blocks += 1
                    blocks.append(len(names))
                nodes.append(nodes[-1] if silent else self._node(nodes[-1], page, TAG_NUMBER.get(name, OTHER), words))
                opened.setdefault(name, []).append(len(names))
                names.append(name)
                silent += name in SILENT
                if name in RAW:
                    end = re.compile(f"</{name}\\b[^>]*(?:>|\\Z)", re.I).search(html, at)
                    at = end.end() if end else size
                    pop()
                elif attributes.endswith("/") and name not in ("p", "div", "a"):
                    pop()
            start = html.find("<", at)
        text(at, size)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parent, page, tag and depth of each node, and where its subtree ends: nodes stand in the order they open in."""
        depth, end = [0] * len(self.parent), list(range(1, len(self.parent) + 1))
        for k, p in enumerate(self.parent):
            if p >= 0:
                depth[k] = depth[p] + 1
        for k in range(len(self.parent) - 1, -1, -1):
            p = self.parent[k]
            if p >= 0 and end[p] < end[k]:
                end[p] = end[k]
        return tuple(np.array(x, dtype=np.int64) for x in (self.parent, self.page, self.tag, depth, end))
