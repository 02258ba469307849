"""Aisle classifier, keyword tags and presentations: rule tables compiled into one expression over the whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions.money import lookup
from larder.functions.rules import Rule, RuleIndex, any_match, earliest_match, first_match, layer
from larder.functions.starter_rules import STARTER_RULES
from larder.functions.text import capitalise_first, fold, let

#: A smaller rule table is a pattern per target.
LOOKED_UP_RULES = 200


@dataclass(frozen=True)
class Taxonomy:
    """Rules and what a source's own bucket says when they do not decide."""

    rules: tuple[Rule, ...] = STARTER_RULES
    authoritative: tuple[str, ...] = ("mascotas",)
    closed: tuple[str, ...] = ("aseo-hogar", "congelados")
    fresh: str = "frutas-verduras"
    fallback: tuple[tuple[str, str], ...] = (
        ("viveres", "otros"), ("lacteos", "leche"), ("carnes", "carnes"), ("frutas-verduras", "verduras"),
        ("panaderia", "pan"), ("bebidas", "jugos"), ("congelados", "congelados"), ("aseo-hogar", "aseo-hogar"),
        ("cuidado-personal", "cuidado-personal"), ("bebes", "bebes"), ("mascotas", "mascotas"), ("otros", "otros"),
    )
    default: str = "otros"


def plain_words(name: Column) -> Column:
    """Folded name without repeated heads, flavours, fillings and hot dogs, with a blank at both ends."""
    text = F.regexp_replace(fold(name), fixed.REPEATED_HEAD, "$1")
    text = F.regexp_replace(text, fixed.FLAVOUR_PHRASE, " ")
    text = F.regexp_replace(text, fixed.FILLING_PHRASE, " ")
    text = F.regexp_replace(text, fixed.HOT_DOG, " perrocaliente ")
    return F.concat(F.lit(" "), text, F.lit(" "))


def _in_head(name: str) -> bool:
    return name == "head" or name.startswith("closed:")


def aisle_of(text: Column, bucket: Column, taxonomy: Taxonomy, looked_up: int = LOOKED_UP_RULES) -> Column:
    """The aisle of a prepared text: the strongest layer that has an answer, and never null.

    From ``looked_up`` rules on, every layer's rules are looked up in one reading of the text, so a table of thousands of
    rules costs little more than a small one; fewer rules are patterns of their own. Both give the same answers.
    """
    rules = taxonomy.rules
    if len(rules) < looked_up:
        def first(name: str, aisle: Column | None = None) -> Column:
            own = layer(rules, name)
            found = first_match(text, own, aisle, head=_in_head(name))
            return found if _in_head(name) or len(own) < 2 else F.when(any_match(text, own), found)

        def first_of_head(name: str, aisle: Column | None = None) -> Column:
            return first(name, aisle) if _in_head(name) else F.lit(None).cast("string")

        # most texts hold no keyword at all: one reading tells, instead of one for every target
        produce, none = layer(rules, "produce"), F.lit(None).cast("string")
        by_word = _strongest(bucket, taxonomy, first, F.when(any_match(text, produce), earliest_match(text, produce)))
        anything = any_match(text, [r for r in rules if not _in_head(r.layer)])
        return F.when(anything, by_word).otherwise(_strongest(bucket, taxonomy, first_of_head, none))
    body, head = RuleIndex([r for r in rules if not _in_head(r.layer)]), RuleIndex([r for r in rules if _in_head(r.layer)], head=True)

    def chosen(hits: Column) -> Column:
        def first(name: str, aisle: Column | None = None) -> Column:
            return head.first(hits["head"], name, aisle) if _in_head(name) else body.first(hits["body"], name, aisle)

        produce = layer(rules, "produce")
        by_word = all(RuleIndex.is_plain(r) for r in produce)
        return _strongest(bucket, taxonomy, first, body.earliest(hits["body"], "produce") if by_word else earliest_match(text, produce))

    return let(F.struct(body.hits(text).alias("body"), head.hits(text).alias("head")), chosen)


def _strongest(bucket: Column, taxonomy: Taxonomy, first: Callable[..., Column], produce: Column) -> Column:
    own = lookup(bucket, dict(taxonomy.fallback)) if taxonomy.fallback else F.lit(None).cast("string")
    fallback = F.coalesce(own, F.lit(taxonomy.default))
    closed = F.lit(None).cast("string")
    for aisle in taxonomy.closed:
        closed = F.when(bucket == aisle, F.coalesce(first(f"closed:{aisle}"), fallback)).otherwise(closed)
    authoritative = F.when(bucket.isin(*taxonomy.authoritative), fallback) if taxonomy.authoritative else F.lit(None)
    return F.coalesce(
        authoritative,
        first("pets"),
        first("non_food"),
        closed,
        first("frozen"),
        first("exceptions"),
        first("head", bucket),
        first("form"),
        F.when(bucket == taxonomy.fresh, produce),
        first("ingredient"),
        F.when(bucket.isNull(), produce),
        fallback,
    )


def classify(
    products: DataFrame,
    taxonomy: Taxonomy = Taxonomy(),
    name: str = "name",
    bucket: str = "source_bucket",
    out: str = "category_slug",
) -> DataFrame:
    """Add the aisle of every product. No shuffle, no UDF: one projection."""
    prepared = products.withColumn("_text", plain_words(F.col(name)))
    return prepared.withColumn(out, aisle_of(F.col("_text"), F.col(bucket), taxonomy)).drop("_text")


def reclassify(catalog: DataFrame, taxonomy: Taxonomy = Taxonomy()) -> DataFrame:
    """The stored catalogue with ``category_slug`` filed anew and the old one beside it as ``before``."""
    return classify(catalog.withColumnRenamed("category_slug", "before"), taxonomy)


def moves(reclassified: DataFrame, top: int = 15) -> DataFrame:
    """The commonest moves between aisles, most first."""
    return (
        reclassified.where(~F.col("before").eqNullSafe(F.col("category_slug")))
        .groupBy("before", F.col("category_slug").alias("after"))
        .agg(F.count(F.lit(1)).alias("products"))
        .orderBy(F.desc("products"), "before", "after")
        .limit(top)
    )


def tag_by_keywords(
    df: DataFrame,
    text: str,
    rules: Sequence[Rule],
    fallback: dict[str, str] | None = None,
    category: str | None = None,
    default: str | None = None,
    out: str = "tag",
) -> DataFrame:
    """First matching keyword rule, else the category's tag, else the default."""
    choices = [first_match(F.col("_text"), [Rule(r.layer, r.keyword, r.slug, r.aisles, True) for r in rules])]
    if fallback and category:
        choices.append(lookup(F.col(category), fallback))
    choices.append(F.lit(default).cast("string"))
    return df.withColumn("_text", fold(F.col(text))).withColumn(out, F.coalesce(*choices)).drop("_text")


def _number(value: Column) -> Column:
    """At most three decimals, no trailing zeros, decimal comma."""
    text = F.round(value, 3).cast("decimal(20,3)").cast("string")
    return F.replace(F.regexp_replace(text, r"\.?0+$", ""), F.lit("."), F.lit(","))


def measure_label(value: Column, measure: Column) -> Column:
    """``500 g``, ``1,5 kg``, ``2 L``: thousands of g and ml become kg and L."""
    thousand = (value >= 1000) & measure.isin("g", "ml")
    unit = F.when(measure == "g", "kg").otherwise("L")
    plain = F.concat(_number(value), F.lit(" "), lookup(measure, fixed.MEASURE_LABELS))
    return F.when(thousand, F.concat(_number(value / 1000), F.lit(" "), unit)).otherwise(plain)


def describe_presentations(products: DataFrame, quantity: str | None = None) -> DataFrame:
    """Add container (singular, plural), label, and with a quantity the counted container and the total content."""
    value, measure, kind = F.col("unit_value"), F.col("unit_measure"), F.col("unit_kind")
    text = fold(F.col("name"))
    egg = value.isNotNull() & F.coalesce(first_match(text, [Rule("egg", "huevo", "egg")]) == "egg", F.lit(False))
    pieces = F.concat(F.lit("x "), _number(value))
    size = F.coalesce(measure_label(value, measure), F.lit(""))
    named = first_match(text, [Rule("container", k, f"{one}|{many}") for k, one, many in fixed.CONTAINERS])

    def shape(one: str, many: str, suffix: Column) -> Column:
        return F.struct(F.lit(one).alias("singular"), F.lit(many).alias("plural"), suffix.alias("suffix"))

    nothing = F.lit("")
    chosen = (
        F.when(egg & (value >= 24), shape("cartón", "cartones", pieces))
        .when(egg & (value == 12), shape("docena", "docenas", nothing))
        .when(egg & (value == 6), shape("media docena", "medias docenas", nothing))
        .when(egg, shape("panal", "panales", pieces))
        .when(
            named.isNotNull(),
            F.struct(
                F.split_part(named, F.lit("|"), F.lit(1)).alias("singular"),
                F.split_part(named, F.lit("|"), F.lit(2)).alias("plural"),
                size.alias("suffix"),
            ),
        )
        .when((kind == "unit") & (value > 1), shape("paquete", "paquetes", pieces))
        .when(kind == "unit", shape("unidad", "unidades", nothing))
        .when(kind == "volume", shape("envase", "envases", size))
        .otherwise(shape("paquete", "paquetes", size))
    )
    shown = products.withColumn("_shape", chosen)
    suffix = F.col("_shape.suffix")
    label = F.when(suffix != "", F.concat_ws(" ", capitalise_first(F.col("_shape.singular")), suffix)).otherwise(
        capitalise_first(F.col("_shape.singular"))
    )
    added = {"container": F.col("_shape.singular"), "containers": F.col("_shape.plural"), "presentation": label}
    if quantity is not None:
        count = F.col(quantity)
        added["quantity_label"] = F.concat(
            _number(count), F.lit(" "), F.when(count == 1, F.col("_shape.singular")).otherwise(F.col("_shape.plural"))
        )
        added["total_content"] = F.when(count > 1, measure_label(value * count, measure))
    return shown.withColumns(added).drop("_shape")
