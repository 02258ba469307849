"""Ordered look-backs that survive a hot key.

A window over a key sends all its rows to one task. Here a key with more than ``target_rows`` rows is cut into equal
slices of its order range, the window runs inside each slice, and what the earlier slices end with is carried in. The
table of hot keys has at most N / target_rows rows and the table of slice ends at most 2 N / target_rows, so both are
broadcast; the input is shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TARGET_ROWS = 1_000_000
SLICE = "_slice"


def _hot_keys(df: DataFrame, keys: Sequence[str], at: Column, target_rows: int) -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_lo"), F.max(at).alias("_hi"))
        .where(F.col("_n") > target_rows)
        .select(
            *[F.col(k).alias(f"_hot_{k}") for k in keys],
            F.ceil(F.col("_n") / F.lit(target_rows)).cast("int").alias("_slices"),
            "_lo",
            "_hi",
        )
    )


def _same(keys: Sequence[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def _sliced(df: DataFrame, keys: Sequence[str], at: Column, target_rows: int, how: str) -> DataFrame:
    """``how='left'`` keeps every row; ``how='inner'`` only the rows of hot keys."""
    hot = F.broadcast(_hot_keys(df, keys, at, target_rows))
    share = (at - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1))
    return (
        df.join(hot, _same(keys, "_hot_"), how)
        .withColumn(SLICE, F.coalesce(F.floor(share * F.col("_slices")).cast("int"), F.lit(0)))
        .drop(*[f"_hot_{k}" for k in keys], "_slices", "_lo", "_hi")
    )


def in_slices(df: DataFrame, keys: Sequence[str], at: Column, target_rows: int = TARGET_ROWS, only_hot: bool = False) -> DataFrame:
    """Add ``_slice``, the number of a row's slice of its key; rows of one ``at`` share a slice, keys that aren't hot have one."""
    return _sliced(df, keys, at, target_rows, "inner" if only_hot else "left")


def _carry(
    df: DataFrame, inside: DataFrame, keys: Sequence[str], ends: DataFrame, carried: Column, merged, out: str
) -> DataFrame:
    """Bring the value carried by earlier slices to the rows of a slice."""
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        *[F.col(k).alias(f"_end_{k}") for k in keys], F.col(SLICE).alias("_end_slice"), carried.over(before).alias("_carry")
    )
    joined = inside.join(
        F.broadcast(carry), _same(keys, "_end_") & (F.col(SLICE) == F.col("_end_slice")), "left"
    )
    return joined.select(*df.columns, merged(F.col("_inside"), F.col("_carry")).alias(out))


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    at: Column,
    columns: Sequence[str],
    out: str = "previous",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``out``: a struct of ``columns`` of the row just before, per key. ``at`` is numeric and leads ``order``."""
    within = Window.partitionBy(*keys, SLICE).orderBy(*order)
    payload = F.struct(*columns)
    inside = _sliced(df, keys, at, target_rows, "left").withColumn("_inside", F.lag(payload).over(within))
    ends = (
        _sliced(df, keys, at, target_rows, "inner")
        .groupBy(*keys, SLICE)
        .agg(F.max_by(payload, F.struct(*order)).alias("_last"))
    )
    return _carry(df, inside, keys, ends, F.last("_last", ignorenulls=True), F.coalesce, out)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    at: Column,
    value: Column,
    out: str = "known",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``out``: the latest non-null ``value`` at or before each row, per key."""
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = _sliced(df, keys, at, target_rows, "left").withColumn("_inside", F.last(value, ignorenulls=True).over(within))
    ends = (
        _sliced(df, keys, at, target_rows, "inner")
        .groupBy(*keys, SLICE)
        .agg(F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias("_last"))
    )
    return _carry(df, inside, keys, ends, F.last("_last", ignorenulls=True), F.coalesce, out)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    at: Column,
    value: Column,
    out: str = "running",
    target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and including each row, per key."""
    within = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = _sliced(df, keys, at, target_rows, "left").withColumn("_inside", F.sum(value).over(within))
    ends = _sliced(df, keys, at, target_rows, "inner").groupBy(*keys, SLICE).agg(F.sum(value).alias("_last"))
    merged = lambda here, carry: F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return _carry(df, inside, keys, ends, F.sum("_last"), merged, out)
