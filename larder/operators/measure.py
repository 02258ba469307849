"""Sizes read from names, and names and brands cleaned, as columns over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.fixed import SPACE
from larder.functions.money import lookup
from larder.functions.text import capitalise_first, let, squeeze, strip, words

_LAST_SIZE = rf"[0-9]+(?:[.,][0-9]+)?{SPACE}*[a-zA-Zñ]+{SPACE}*$"
_GROUP = r"\(([^)]*)\)"


def _judge(part: Column) -> Column:
    """A size, ``untrusted``, or null for one piece of text. ``part``: before, number, unit, lead, text."""
    before, number, unit = part["before"], part["number"], part["unit"]
    context = F.concat(part["lead"], F.lit(" "), before)
    kind = lookup(unit, fixed.UNIT_KIND)
    previous = lookup(F.lower(F.regexp_extract(before, fixed.MEASURE_BEFORE, 1)), fixed.UNIT_SPELLINGS)
    small = unit.isin(*fixed.SMALL_UNITS)
    thousands = small & number.rlike(r"^[1-9][0-9]{0,2}\.[0-9]{3}$")
    either_way = small & number.rlike(r"^[1-9][0-9]{0,2},[0-9]{3}$")
    value = (
        F.when(thousands, F.replace(number, F.lit("."), F.lit("")))
        .otherwise(F.replace(number, F.lit(","), F.lit(".")))
        .try_cast("double")
    )
    doubtful = (
        before.rlike(fixed.PACK_COUNT_BEFORE)
        | before.rlike(fixed.NOT_A_SIZE_BEFORE)
        | F.coalesce(lookup(previous, fixed.UNIT_KIND) == kind, F.lit(False))
        | (before.rlike(fixed.SPLIT_DECIMAL_BEFORE) & number.rlike(r"^[0-9]{1,2}$"))
        | context.rlike(fixed.COMBO)
        | context.rlike(fixed.PLUS_COUNT_BEFORE)
        | ((unit == "kg") & F.concat(part["lead"], F.lit(" "), part["text"]).rlike(fixed.PET_DOSE))
        | either_way
    )
    base = value * lookup(unit, fixed.UNIT_FACTOR)
    low = lookup(kind, {k: float(v[0]) for k, v in fixed.PLAUSIBLE.items()})
    high = lookup(kind, {k: float(v[1]) for k, v in fixed.PLAUSIBLE.items()})
    state = (
        F.when(unit.isNull(), F.lit(None).cast("string"))
        .when(doubtful, "untrusted")
        .when(~F.coalesce(value > 0, F.lit(False)), F.lit(None).cast("string"))
        .when(base.between(low, high), "read")
        .otherwise("untrusted")
    )
    return F.struct(state.alias("state"), value.alias("value"), unit.alias("measure"))


def _part(text: Column, lead: Column) -> Column:
    """The size a text ends with, taken apart: what stands before it, its number, its unit."""

    def apart(tail: Column) -> Column:
        spelled = F.lower(F.regexp_extract(tail, rf"([a-zA-Zñ]+){SPACE}*$", 1))
        return F.struct(
            F.regexp_replace(F.left(text, F.length(text) - F.length(tail)), f"{fixed.SPACE}+", " ").alias("before"),
            F.regexp_extract(tail, r"^([0-9]+(?:[.,][0-9]+)?)", 1).alias("number"),
            lookup(spelled, fixed.UNIT_SPELLINGS).alias("unit"),
            lead.alias("lead"),
            text.alias("text"),
        )

    return let(F.regexp_extract(text, _LAST_SIZE, 0), apart)


def measure_of(name: Column) -> Column:
    """Struct (value, measure) of a name, or null. The last parenthesis is read first, the loose end last.

    The first piece that shows a size decides: one that cannot be trusted ends the search.
    """
    groups = F.regexp_extract_all(name, F.lit(_GROUP), F.lit(1))
    between = F.split(name, r"\([^)]*\)", -1)
    lead = lambda i: F.concat(
        F.array_join(
            F.zip_with(
                F.slice(between, F.lit(1), i), F.slice(groups, F.lit(1), i), lambda t, g: F.concat(t, F.lit("("), g, F.lit(")"))
            ),
            "",
        ),
        F.get(between, i),
    )
    bracketed = F.reverse(F.transform(groups, lambda text, i: _part(text, lead(i))))
    pieces = F.when(F.size(groups) == 0, F.array(_part(name, F.lit("")))).otherwise(
        F.concat(bracketed, F.array(_part(name, F.lit(""))))
    )
    judged = F.filter(F.transform(pieces, _judge), lambda j: j["state"].isNotNull())
    return let(
        F.get(judged, F.lit(0)),
        lambda j: F.when(j["state"] == "read", F.struct(j["value"].alias("value"), j["measure"].alias("measure"))),
    )


def _spread(df: DataFrame, size: Column) -> DataFrame:
    sized = df.withColumn("_size", size)
    return sized.withColumns(
        {
            "unit_kind": F.coalesce(lookup(F.col("_size.measure"), fixed.UNIT_KIND), F.lit("unit")),
            "unit_value": F.col("_size.value").cast("decimal(10,3)"),
            "unit_measure": F.col("_size.measure"),
        }
    ).drop("_size")


def extract_measures(products: DataFrame, name: str = "name") -> DataFrame:
    """Add unit_kind, unit_value and unit_measure read from the name; no size means kind ``unit`` and nulls."""
    return _spread(products, measure_of(F.col(name)))


_ERP_TOKEN = (
    rf"((?<![A-Za-z0-9_.,/])[0-9]+{SPACE}+)?"
    rf"((?<![A-Za-z0-9_.,]|[0-9][.,]{SPACE})([0-9]+(?:[.,][0-9]+)?){SPACE}?([A-Za-z]+){fixed.WORD_END})"
)


def erp_measure_of(title: Column, aisle: Column) -> Column:
    """Struct (value, measure, token) of a shouted title: exactly one size or one count, else null."""
    pick = lambda group: F.regexp_extract_all(title, F.lit(_ERP_TOKEN), F.lit(group))
    tokens = F.arrays_zip(
        pick(1).alias("count_before"), pick(2).alias("text"), pick(3).alias("number"), pick(4).alias("spelled")
    )
    liquid = aisle.isin(*fixed.ERP_LIQUID_AISLES)
    food = aisle.isin(*fixed.ERP_FOOD_AISLES)

    def usable(token: Column) -> Column:
        spelled = F.upper(token["spelled"])
        amount = F.replace(token["number"], F.lit(","), F.lit(".")).try_cast("double")
        bare = spelled.isin(*fixed.ERP_BARE_UNITS)
        as_volume = F.coalesce(liquid | (food & (amount >= fixed.ERP_MIN_BARE_VOLUME)), F.lit(False))
        metres = (spelled == "M") & title.rlike(fixed.ERP_ROLL_GOODS)
        return lookup(spelled, fixed.ERP_UNITS).isNotNull() & ~metres & (~bare | as_volume)

    kept = F.transform(
        F.filter(tokens, usable),
        lambda t: F.struct(
            (F.length(t["count_before"]) > 0).alias("counted"),
            t["text"].alias("text"),
            t["number"].alias("number"),
            lookup(F.upper(t["spelled"]), fixed.ERP_UNITS).alias("measure"),
        ),
    )

    def choose(found: Column) -> Column:
        sizes = F.filter(found, lambda t: t["measure"] != "un")
        only = F.get(found, F.lit(0))
        # a bare number right before a size may be a count of pieces
        clear = (F.size(found) == 1) & ~F.exists(sizes, lambda t: t["counted"])
        return F.when(clear, only)

    chosen = let(kept, choose)

    def read(token: Column) -> Column:
        size = measure_of(F.concat(token["number"], F.lit(" "), token["measure"]))
        return let(
            size,
            lambda s: F.when(
                s["value"] <= lookup(s["measure"], {k: float(v) for k, v in fixed.ERP_MAX.items()}),
                F.struct(s["value"].alias("value"), s["measure"].alias("measure"), token["text"].alias("token")),
            ),
        )

    refused = title.rlike(fixed.ERP_MULTIPACK) | title.rlike(fixed.COMBO)
    return F.when(~refused, let(chosen, read))


def extract_measures_erp(products: DataFrame, title: str = "title", aisle: str = "aisle") -> DataFrame:
    """As ``extract_measures`` for shouted titles, plus ``size_token``: the text to take out of the name."""
    sized = products.withColumn("_erp", erp_measure_of(F.col(title), F.col(aisle)))
    return _spread(sized, F.col("_erp")).withColumn("size_token", F.col("_erp.token")).drop("_erp")


def _has_product_word(parts: Column) -> Column:
    plain = F.transform(parts, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    return F.exists(
        plain,
        lambda w: w.rlike(r"\p{L}") & ~w.rlike(fixed.MEASURE_WORD) & ~w.isin(*fixed.FILLER_WORDS),
    )


def clean_name(name: Column, brand: Column) -> Column:
    """The name without parentheses and without its brand, unless the name opens with the brand or is nothing else.

    The brand differs by row, so no pattern is built from it: the name's words are walked and compared with the
    brand's by slices.
    """
    plain = squeeze(F.regexp_replace(name, r"\([^)]*\)", " "))
    no_array = F.array().cast("array<string>")

    def without_brand(parts: Column, own: Column) -> Column:
        size = F.size(own)
        lowered = F.transform(parts, F.lower)
        start = F.struct(F.lit(0).alias("skip"), no_array.alias("kept"))

        def step(state: Column, i: Column) -> Column:
            here = F.slice(lowered, i + 1, size) == own
            return (
                F.when(
                    state["skip"] > 0, F.struct((state["skip"] - 1).alias("skip"), state["kept"].alias("kept"))
                )
                .when(here, F.struct((size - 1).alias("skip"), state["kept"].alias("kept")))
                .otherwise(
                    F.struct(F.lit(0).alias("skip"), F.concat(state["kept"], F.array(F.get(parts, i))).alias("kept"))
                )
            )

        positions = F.when(F.size(parts) > 0, F.sequence(F.lit(0), F.size(parts) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        kept = F.aggregate(positions, start, step, lambda state: state["kept"])
        opens = F.slice(lowered, F.lit(1), size) == own
        return let(
            kept, lambda k: F.when(opens | ~_has_product_word(k), F.array_join(parts, " ")).otherwise(F.array_join(k, " "))
        )

    pair = F.struct(words(plain).alias("parts"), words(F.lower(brand)).alias("own"))
    stripped = let(pair, lambda p: without_brand(p["parts"], p["own"]))
    # most names do not hold their brand: a plain search spares them the walk
    mentions = F.contains(F.lower(plain), squeeze(F.lower(brand)))
    return F.when(F.coalesce((strip(brand) != "") & mentions, F.lit(False)), stripped).otherwise(plain)


def display_name(name: Column, brand: Column) -> Column:
    """The cleaned name with a capital, or the raw one when nothing is left of it."""
    cleaned = clean_name(name, brand)
    return capitalise_first(F.when(cleaned != "", cleaned).otherwise(strip(name)))


def clean_brand(brand: Column) -> Column:
    """Title case; placeholders (no brand, generic, n/a, dashes, codes with separators) are null."""
    trimmed = strip(brand)
    real = (trimmed != "") & ~trimmed.rlike(fixed.PLACEHOLDER_BRAND)
    return F.when(real, F.initcap(squeeze(F.lower(trimmed))))


def clean_names(products: DataFrame, name: str = "name", brand: str = "brand", out: str = "clean_name") -> DataFrame:
    return products.withColumn(out, display_name(F.col(name), F.col(brand)))


def clean_brands(products: DataFrame, brand: str = "brand", out: str = "clean_brand") -> DataFrame:
    return products.withColumn(out, clean_brand(F.col(brand)))


def parse_prices(raw: DataFrame, amount: str, out: str = "price_cop") -> DataFrame:
    """Numbers to whole pesos; anything unusable is null."""
    from larder.functions.money import to_cop

    return raw.withColumn(out, to_cop(F.col(amount)))
