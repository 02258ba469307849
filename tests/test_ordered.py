"""Look-backs over hot keys must equal plain windows: slices of a few rows force the carry everywhere."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.ordered import last_known, previous_row, running_total


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(3)
    data = [(k, random.randint(0, 40), i, random.choice([None, 1, 2, 3, 5])) for i, k in enumerate(["hot"] * 300 + ["a"] * 7 + [None] * 30)]
    return spark.createDataFrame(data, "k string, at long, id int, x int")


@pytest.mark.parametrize("target", [3, 50, 10_000])
def test_lookbacks_equal_windows(rows, target):
    order = [F.col("at"), F.col("id")]
    w = Window.partitionBy("k").orderBy(*order)
    plain = rows.select(
        "k", "id", F.lag("x").over(w).alias("lag"), F.lag("id").over(w).alias("before"),
        F.last("x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last"),
        F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
    )
    want = {(r.k, r.id): (r.lag, r.before, r["last"], r.total or 0) for r in plain.collect()}
    lag = previous_row(rows, ["k"], order, F.col("at"), ["x", "id"], "p", target)
    last = last_known(rows, ["k"], order, F.col("at"), F.col("x"), "l", target)
    total = running_total(rows, ["k"], order, F.col("at"), F.col("x"), "t", target)
    got = {(r.k, r.id): [r.p["x"] if r.p else None, r.p["id"] if r.p else None] for r in lag.collect()}
    for r in last.collect():
        got[(r.k, r.id)].append(r["l"])
    for r in total.collect():
        got[(r.k, r.id)].append(r.t)
    assert {k: tuple(v) for k, v in got.items()} == want
