"""Looked-up rules against the patterns they stand for."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import functions as F

from larder.functions.rules import Rule, RuleIndex, any_match, earliest_match, first_match, keyword_pattern
from larder.functions.starter_rules import STARTER_RULES
from larder.operators.classify import Taxonomy, aisle_of, classify, plain_words

WORDS = ["te", "papa", "sal", "hot", "dog", "pan", "es", "s", "x", "2", "a1", "_b"]
#: Names, the bucket their source files them in, and the aisle that the starter rules must give.
STARTER_CASES = (
    ("Galleta de arroz", None, "galletas"), ("Papa criolla", "frutas-verduras", "verduras"), ("Papas limón", "otros", "snacks"), ("Papa", None, "verduras"),
    ("Tomate manzana", "frutas-verduras", "verduras"), ("Manzana tomate", "frutas-verduras", "frutas"), ("Helado de mango", "otros", "congelados"),
    ("Muslo de pollo", "viveres", "pollo"), ("Cosas varias", "otros", "otros"), ("Hueso de cerdo", "mascotas", "mascotas"), ("Qwerty", "lacteos", "leche"),
    ("JUGO de mango", None, "jugos"), ("Ambientador vainilla", "congelados", "aseo-hogar"), ("Arepas de choclo", "congelados", "arepas"),
    ("Gelatina de pera", None, "dulces"), ("3 x Galletas", None, "galletas"), ("3xgalleta", None, "galletas"), (None, None, "otros"), ("", "lacteos", "leche"),
)


def random_rules(rng: random.Random, n: int) -> list[Rule]:
    rules = []
    for k in range(n):
        word = " ".join(rng.choice(WORDS) for _ in range(rng.choice((1, 1, 1, 2, 3)))) + rng.choice(("", "", "*"))
        word = rng.choice((word, word, word, "té", "pa(?:pa|n)", "s[aá]l", "hot-dog"))
        rules.append(Rule("r", word, f"t{k % 5}", (("cold", f"c{k}"), ("none", "n")) if k % 4 == 0 else ()))
    return rules


def random_texts(rng: random.Random, n: int) -> list[str]:
    parts = ["tes", "papas", "panes", "sales", "hots", "ñ", "é", "-", ".", "\t", "teses"] + WORDS
    texts = ["", " ", "2x te", "2 x te", " 12  x  papa sal", "x te", "2xte"]
    return texts + ["".join(rng.choice(parts) + rng.choice((" ", " ", "  ", "", ",")) for _ in range(rng.randrange(1, 7))) for _ in range(n)]


def test_looked_up_rules_are_their_patterns(spark):
    rng = random.Random(9)
    rows = [(t, rng.choice((None, "cold", "warm"))) for t in random_texts(rng, 300)]
    frame = spark.createDataFrame(rows, "t string, aisle string").withColumn("folded", F.lower("t"))
    for size in (0, 1, 6, 40):
        rules = random_rules(rng, size)
        plain = [r for r in rules if RuleIndex.is_plain(r)]
        body, head, words = RuleIndex(rules), RuleIndex(rules, head=True), RuleIndex(plain)
        text, aisle = F.col("folded"), F.col("aisle")
        got = frame.select("t", body.first(body.hits(text), "r", aisle).alias("a"), first_match(text, rules, aisle).alias("b"),
                           head.first(head.hits(text), "r", aisle).alias("c"), first_match(text, rules, aisle, head=True).alias("d"),
                           words.earliest(words.hits(text), "r").alias("e"), earliest_match(text, plain).alias("f"))
        for r in got.collect():
            assert (r["a"], r["c"], r["e"]) == (r["b"], r["d"], r["f"]), (r, rules)


def test_starter_rules(spark):
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(STARTER_CASES)], "k int, name string, source_bucket string, want string")
    assert [r["k"] for r in classify(rows).where("not category_slug <=> want").collect()] == []
    looked_up = rows.withColumn("got", aisle_of(plain_words(F.col("name")), F.col("source_bucket"), Taxonomy(), looked_up=0))
    assert [r["k"] for r in looked_up.where("not got <=> want").collect()] == []


def test_thousands_of_rules_are_one_reading(spark):
    """The plan of a large table has no pattern per rule, and a rule's place among thousands decides."""
    rules = tuple(Rule("exceptions", f"w{k} v{k % 7}", f"s{k}") for k in range(3000)) + (Rule("exceptions", "w5*", "late"),)
    frame = spark.createDataFrame([("a w2999 v3", None), ("w5 v5", None), ("w5 v6", None), ("w59 v3", None), ("none", None)], "name string, source_bucket string")
    out = classify(frame, Taxonomy(rules, (), (), "", (), "rest"))
    assert [r["category_slug"] for r in out.collect()] == ["s2999", "s5", "late", "s59", "rest"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") < 10


def test_texts_without_a_keyword_are_read_once(spark):
    """One pattern of all keywords says whether any rule matches; aisles are those of the looked-up rules."""
    rng = random.Random(8)
    parts = [r.keyword.strip("*") for r in STARTER_RULES] + ["xx", "pan", "8 x", "12", "(", ".", "ñ", "es", "s"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "s ", "es ", "x", "-", "  "]) for _ in range(rng.randrange(5))) for _ in range(400)]
    rows = [(t, rng.choice([None, *dict(Taxonomy().fallback), "?"])) for t in [None, "", *texts]]
    df = spark.createDataFrame(rows, "t string, b string").select(plain_words(F.col("t")).alias("t"), "b").cache()
    body = [r for r in STARTER_RULES if r.layer != "head" and not r.layer.startswith("closed:")]
    text = F.col("t")
    one_by_one = reduce(lambda a, b: a | b, [text.rlike(keyword_pattern(r)) for r in body])
    matched = df.select(any_match(text, body).alias("any"), one_by_one.alias("each")).collect()
    assert all(r["any"] == r["each"] for r in matched) and {r["any"] for r in matched} == {None, True, False}
    gated, looked_up = ([r[0] for r in df.select(aisle_of(text, F.col("b"), Taxonomy(), n)).collect()] for n in (1000, 0))
    df.unpersist()
    assert gated == looked_up and len(set(gated)) > 10
