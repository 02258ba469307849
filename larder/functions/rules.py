"""Keyword rules: compiled once, while the plan is built, into literal patterns that keep rule order."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from larder.fixed import WORD_END, WORD_START

HEAD_START = r"^\s*(?:[0-9]+\s*x\s*)?"
WORD_EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
MAX_RULES = 5_000


@dataclass(frozen=True)
class Rule:
    """One keyword rule: a whole word with an optional plural, or a stem when it ends in ``*``.

    ``aisles`` gives another target per source aisle (``none`` for no aisle at all); ``slug`` is the rest.
    """

    layer: str
    keyword: str
    slug: str
    aisles: tuple[tuple[str, str], ...] = ()
    literal: bool = False


def fold_keyword(keyword: str) -> str:
    lowered = unicodedata.normalize("NFD", keyword.lower())
    return "".join(c for c in lowered if not "\u0300" <= c <= "\u036f").strip()


def keyword_pattern(rule: Rule, head: bool = False) -> str:
    """The pattern of a keyword over folded text; ``head`` ties it to the start of the name."""
    start = HEAD_START if head else WORD_START
    word = fold_keyword(rule.keyword)
    stem = word.endswith("*")
    word = word[:-1] if stem else word
    if rule.literal:
        word = re.escape(word)
    word = word.replace(r"\b", WORD_EDGE)
    return f"{start}(?:{word})" if stem else f"{start}(?:{word})(?:e?s)?{WORD_END}"


def _first_letters(rules: Sequence[Rule]) -> str:
    """A cheap look-ahead for the letters a run of keywords starts with, so most positions of a text fail at once."""
    starts = {fold_keyword(r.keyword)[:1] for r in rules}
    return f"(?=[{''.join(sorted(starts))}])" if all(s.isalnum() and s.isascii() for s in starts) else ""


def _target(rule: Rule, aisle: Column | None) -> Column:
    if not rule.aisles or aisle is None:
        return F.lit(rule.slug)
    key = F.coalesce(aisle, F.lit("none"))
    chosen = F.lit(rule.slug)
    for name, slug in reversed(rule.aisles):
        chosen = F.when(key == name, slug).otherwise(chosen)
    return chosen


def first_match(text: Column, rules: Sequence[Rule], aisle: Column | None = None, head: bool = False) -> Column:
    """Target of the first rule that matches, else null. Neighbours with one target share a pattern."""
    decided: Column | None = None
    for (slug, aisles), run in groupby(rules, key=lambda r: (r.slug, r.aisles)):
        run = list(run)
        pattern = "|".join(keyword_pattern(r, head) for r in run)
        if not head:
            pattern = f"{_first_letters(run)}(?:{pattern})"
        target = _target(run[0], aisle)
        decided = F.when(text.rlike(pattern), target) if decided is None else decided.when(text.rlike(pattern), target)
    return F.lit(None).cast("string") if decided is None else decided


def any_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether any rule matches, in one reading of the text; rules are not tied to its start."""
    own = "|".join(keyword_pattern(r).removeprefix(WORD_START) for r in rules)
    return text.rlike(f"{WORD_START}{_first_letters(rules)}(?:{own})") if rules else F.lit(False)


def earliest_match(text: Column, rules: Sequence[Rule]) -> Column:
    """Target of the match that starts first in the text; equal starts go to the earlier rule."""
    if not rules:
        return F.lit(None).cast("string")
    found = F.array(
        *[
            F.struct(
                F.regexp_instr(text, F.lit(keyword_pattern(r))).alias("at"),
                F.lit(i).alias("ord"),
                F.lit(r.slug).alias("slug"),
            )
            for i, r in enumerate(rules)
        ]
    )
    return F.array_min(F.filter(found, lambda hit: hit["at"] > 0))["slug"]


#: Keywords that are words with single blanks between them are looked up; all others stay patterns.
_PLAIN = re.compile(r"[a-z0-9_]+(?: [a-z0-9_]+)*\*?")
_LOOKUP_BUCKETS = 512


class RuleIndex:
    """Many rules over one text at the cost of its words: runs of words are looked up in a hashed table of all keywords.

    A whole word is looked up as it is and without a plural ending, a stem as the beginning of a word, each by equality. So a
    text is read once however many rules there are; only rules whose keyword is a pattern cost a match each.
    """

    def __init__(self, rules: Sequence[Rule], head: bool = False):
        """``head`` ties every rule to the start of the text."""
        self.rules, self.head = tuple(rules), head
        self.keys: dict[str, list[int]] = {}
        self.patterns: list[int] = []
        self.stems: dict[int, set[int]] = {}
        self.words: set[int] = set()
        for k, rule in enumerate(rules):
            word = fold_keyword(rule.keyword)
            if not self.is_plain(rule):
                self.patterns.append(k)
            elif word.endswith("*"):
                self.keys.setdefault("^" + word[:-1], []).append(k)
                self.stems.setdefault(word.count(" ") + 1, set()).add(len(word) - 1)
            else:
                self.keys.setdefault("=" + word, []).append(k)
                self.words.add(word.count(" ") + 1)

    @staticmethod
    def is_plain(rule: Rule) -> bool:
        return _PLAIN.fullmatch(fold_keyword(rule.keyword)) is not None

    def _table(self) -> Column:
        """Keywords and their rules as one literal: an array of small maps, by hash of the keyword."""
        buckets: list[list[str]] = [[] for _ in range(_LOOKUP_BUCKETS)]
        for key in self.keys:
            buckets[zlib.crc32(key.encode()) % _LOOKUP_BUCKETS].append(key)
        entry = lambda key: f"'{key}', array({', '.join(map(str, self.keys[key]))})"
        maps = [f"map({', '.join(map(entry, b))})" if b else "cast(map() as map<string,array<int>>)" for b in buckets]
        return F.expr(f"array({', '.join(maps)})")

    def _keys_at(self, words: Column, at: Column) -> Column:
        """All that the words from one place on may be looked up as."""
        out = []
        for n in sorted(self.words | set(self.stems)):
            run = F.array_join(F.slice(words, at + 1, n), " ")
            if n in self.words:
                out.append(F.concat(F.lit("="), run))
                for ending in ("s", "es"):
                    cut = F.concat(F.lit("="), F.substring(run, F.lit(1), F.length(run) - len(ending)))
                    out.append(F.when(F.endswith(run, F.lit(ending)), cut))
            out += [F.when(F.length(run) >= size, F.concat(F.lit("^"), F.left(run, F.lit(size)))) for size in sorted(self.stems.get(n, ()))]
        return F.array(*out)

    def hits(self, text: Column) -> Column:
        """Every rule that matches a folded text: an array of ``at`` (which word it starts at) and ``rule`` (its number).

        A rule that is a pattern has the place of its match as ``at``, which counts signs and not words.
        """
        found = [F.expr("cast(array() as array<struct<at:int,rule:int>>)")]
        if self.keys:
            table = self._table()
            known = list(self.keys)

            def at_place(words: Column, at: Column) -> Column:
                own = F.filter(self._keys_at(words, at), lambda key: F.coalesce(key.isin(known), F.lit(False)))
                rules = F.transform(own, lambda key: F.element_at(F.get(table, F.pmod(F.crc32(key.cast("binary")), F.lit(_LOOKUP_BUCKETS)).cast("int")), key))
                return F.transform(F.flatten(rules), lambda k: F.struct(at.cast("int").alias("at"), k.cast("int").alias("rule")))

            def look_up(words: Column) -> Column:
                if self.head:
                    return at_place(words, F.lit(0))
                return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda at: at_place(words, at)))

            starts = [HEAD_START, r"^\s*"] if self.head else [r"^ *"]
            for start in starts:
                # anything but one blank between two words parts them
                broken = F.regexp_replace(F.regexp_replace(text, start, ""), "[^A-Za-z0-9_ ]+| {2,}", " | ")
                found.append(F.element_at(F.transform(F.array(F.split(F.rtrim(broken), " ")), look_up), 1))
        for k in self.patterns:
            own = F.regexp_instr(text, F.lit(keyword_pattern(self.rules[k], self.head)))
            found.append(F.when(own > 0, F.array(F.struct(own.cast("int").alias("at"), F.lit(k).alias("rule")))).otherwise(found[0]))
        return F.concat(*found) if len(found) > 1 else found[0]

    def first(self, hits: Column, name: str, aisle: Column | None = None) -> Column:
        """Target of the layer's first rule among the hits, else null."""
        return self._chosen(hits, name, lambda h: F.struct(h["rule"].alias("rule")), aisle)

    def earliest(self, hits: Column, name: str) -> Column:
        """Target of the layer's hit that starts first; equal starts go to the earlier rule. No rule of the layer is a pattern."""
        if any(self.rules[k].layer == name for k in self.patterns):
            raise ValueError(f"layer {name} has patterns, whose places are not those of words")
        return self._chosen(hits, name, lambda h: F.struct(h["at"].alias("at"), h["rule"].alias("rule")), None)

    def _chosen(self, hits: Column, name: str, order, aisle: Column | None) -> Column:
        own = [k for k, r in enumerate(self.rules) if r.layer == name]
        if not own:
            return F.lit(None).cast("string")
        best = F.array_min(F.transform(F.filter(hits, lambda h: h["rule"].isin(own)), order))["rule"]
        slugs = F.array(*[F.lit(r.slug) for r in self.rules])
        chosen = F.get(slugs, best)
        by_aisle = [(f"{k}|{a}", slug) for k in own for a, slug in self.rules[k].aisles]
        if aisle is not None and by_aisle:
            pairs = F.create_map(*[F.lit(x) for pair in by_aisle for x in pair])
            chosen = F.coalesce(F.element_at(pairs, F.concat_ws("|", best.cast("string"), F.coalesce(aisle, F.lit("none")))), chosen)
        return F.when(best.isNotNull(), chosen)


def layer(rules: Iterable[Rule], name: str) -> list[Rule]:
    return [r for r in rules if r.layer == name]


def load_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules from JSON lines ``layer, ord, keyword, slug, aisles map?``; a configuration table, so small by contract."""
    table = spark.read.schema(
        "layer string, ord int, keyword string, slug string, aisles map<string,string>, literal boolean"
    ).json(path)
    rows = table.orderBy("layer", "ord").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules: this is a configuration table, not data")
    return [
        Rule(r["layer"], r["keyword"], r["slug"], tuple(sorted((r["aisles"] or {}).items())), bool(r["literal"]))
        for r in rows
    ]
