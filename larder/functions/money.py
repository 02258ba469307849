"""Price columns: rounding, parsing, jumps, steps, price per unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.fixed import PRICE_JUMP, UNIT_BASE, UNIT_FACTOR, UNIT_REFERENCE
from larder.functions.text import strip


def lookup(col: Column, table: dict) -> Column:
    """A small fixed table as one map literal: the key is worked out once, whatever the table's size."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.try_element_at(F.create_map(*entries), col)


def to_cop(amount: Column) -> Column:
    """Whole pesos, or null for anything that is not a usable price."""
    rounded = F.floor(amount.cast("double") + 0.5)
    usable = amount.isNotNull() & ~F.isnan(amount.cast("double")) & (rounded > 0)
    return F.when(usable & (rounded < 9e15), rounded.cast("bigint"))


def text_price_readable(text: Column) -> Column:
    """Digits with an optional ``.00``; real cents or any other punctuation mean another format."""
    return F.coalesce(strip(text).rlike(r"^[0-9]+(?:\.0{1,2})?$"), F.lit(False))


def text_price(text: Column) -> Column:
    """Pesos of a readable price text; null when malformed, zero or beyond a long."""
    digits = F.regexp_extract(strip(text), r"^([0-9]+)(?:\.0{1,2})?$", 1)
    return F.when(text_price_readable(text), to_cop(digits.try_cast("double")))


def is_jump(previous: Column, price: Column) -> Column:
    """A price ten times the previous one, or a tenth of it, is a reading error."""
    before, after = previous.cast("bigint"), price.cast("bigint")
    return F.coalesce((after >= before * PRICE_JUMP) | (after * PRICE_JUMP <= before), F.lit(False))


def change_delta(previous: Column, current: Column) -> Column:
    delta = current.cast("bigint") - previous.cast("bigint")
    return F.when(previous <= 0, F.lit(0).cast("bigint")).otherwise(delta)


def change_direction(previous: Column, current: Column) -> Column:
    return (
        F.when((previous <= 0) | (current == previous), "same").when(current > previous, "up").otherwise("down")
    )


def change_percent(previous: Column, current: Column) -> Column:
    share = F.abs(current.cast("double") - previous.cast("double")) / previous.cast("double") * 100
    return F.when((previous <= 0) | (current == previous), F.lit(0).cast("bigint")).otherwise(
        F.floor(share + 0.5).cast("bigint")
    )


def base_measure(measure: Column) -> Column:
    return lookup(measure, UNIT_BASE)


def base_amount(value: Column, measure: Column) -> Column:
    """Size in g, ml or units."""
    return value.cast("double") * lookup(measure, UNIT_FACTOR)


def per_amount(measure: Column) -> Column:
    return lookup(base_measure(measure), UNIT_REFERENCE)


def unit_price(price: Column, value: Column, measure: Column) -> Column:
    """Price per 100 g, 100 ml or one unit; null without a measure."""
    amount = base_amount(value, measure)
    return F.when(amount > 0, F.floor(price / amount * per_amount(measure) + 0.5).cast("bigint"))
