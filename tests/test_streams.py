"""Streams: keyed prices with a seed and a restart, versions per batch, the abort gate."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from larder import schemas
from larder.streaming import jobs

STAGED = "store_product_id string, region_code string, price_cop int, list_price_cop int, captured_at timestamp"


def land(spark, path, rows, day):
    spark.createDataFrame([(p, "NACIONAL", c, None) for p, c in rows], "store_product_id string, region_code string, price_cop int, list_price_cop int").withColumn(
        "captured_at", F.lit(f"2026-10-{day:02d}").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_price_changes_restart_from_their_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    current = spark.createDataFrame([("a", "NACIONAL", 4200)], "store_product_id string, region_code string, price_cop int")

    def run():
        stream = spark.readStream.schema(STAGED).parquet(source)
        jobs.start_price_changes(stream, out, checkpoint, current).awaitTermination()
        rows = spark.read.schema(jobs.CHANGES).parquet(out).collect()
        return {(r.store_product_id, r.previous_cop, r.price_cop, r.decision) for r in rows}

    land(spark, source, [("a", 4200), ("b", 100)], 1)
    assert run() == {("b", None, 100, "new")}
    land(spark, source, [("a", 42000), ("b", 100)], 2)
    assert run() == {("a", 4200, 42000, "jump"), ("b", None, 100, "new")}
    land(spark, source, [("a", 4500), ("b", 150)], 3)
    # the refused jump was not remembered: the next price is compared with 4200
    assert run() == {("b", None, 100, "new"), ("a", 4200, 42000, "jump"), ("a", 4200, 4500, "changed"), ("b", 100, 150, "changed")}


def test_publish_versions(spark, tmp_path):
    source = str(tmp_path / "in")
    for n, price in enumerate((100, 200, 300)):
        spark.createDataFrame([(n, "a", "NACIONAL", price, None)], "id long, store_product_id string, region_code string, price_cop int, list_price_cop int").withColumn(
            "captured_at", F.lit(f"2026-10-0{n + 1}").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schemas.SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(source)
    seed = spark.createDataFrame([], schemas.CURRENT)
    query = jobs.publish_batches(stream, str(tmp_path / "current"), str(tmp_path / "cp"), seed)
    query.awaitTermination()
    last = query.lastProgress["batchId"]
    assert last == 2 and jobs.published(spark, str(tmp_path / "current"), last).first().price_cop == 300


def test_abort_gate_keeps_what_was_written(spark, tmp_path):
    source = str(tmp_path / "in")
    good = spark.range(60).select(F.lit("s").alias("store"), F.lit("ok").alias("status"), "id")
    bad = spark.range(40).select(F.lit("s").alias("store"), F.lit("failed").alias("status"), "id")
    good.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(good.schema).option("maxFilesPerTrigger", 1).parquet(source)
    gate = jobs.AbortGate(spark, str(tmp_path / "gate"))
    jobs.write_until_aborted(stream, str(tmp_path / "out"), str(tmp_path / "cp"), gate).awaitTermination()
    assert gate.tripped().count() == 0
    bad.coalesce(1).write.mode("append").parquet(source)
    failed = False
    try:
        jobs.write_until_aborted(stream, str(tmp_path / "out"), str(tmp_path / "cp"), gate).awaitTermination()
    except Exception as error:  # noqa: BLE001
        failed = "unreadable limit" in str(error)
    assert failed and spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_publish_stream_merges_into_published_prices(spark, monkeypatch):
    """The registered query starts from real prices, and newer ones arrive for some of them."""
    seeds = []
    publish = jobs.publish_batches
    monkeypatch.setattr(jobs, "publish_batches", lambda snapshots, path, checkpoint, seed, **more: seeds.append(seed) or publish(snapshots, path, checkpoint, seed, **more))
    last = queries()["publish_stream"](spark, "/root/testdata/sf0.001")
    key = ["store_product_id", "region_code"]
    both = seeds[0].select(*key, F.col("price_cop").alias("before")).join(last, key).collect()
    assert len(both) == seeds[0].count() > 0
    assert any(r["before"] != r["price_cop"] for r in both)


def test_price_changes_of_many_keys_share_their_state(spark, tmp_path):
    """Hundreds of keys with nulls, jumps and equal times, over two micro-batches and a seed, against a loop over the rows."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    rng, source, out, checkpoint = random.Random(3), *(str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    keys = [(p, r) for p in [None, *(f"p{i}" for i in range(150))] for r in (None, "NACIONAL", "BOG")]
    seed = [(*key, rng.choice([9, 100])) for key in keys[::5]]
    current = spark.createDataFrame(seed, "store_product_id string, region_code string, price_cop int")
    held, want = {(p, r): price for p, r, price in seed}, []
    for day in (1, 2):
        rows = [(*rng.choice(keys), rng.choice([9, 10, 100, 101]), rng.choice([None, 7]), datetime(2026, 10, day, rng.randint(0, 3))) for _ in range(1500)]
        spark.createDataFrame(rows, STAGED).repartition(3).write.mode("append").parquet(source)
        for p, r, price, listed, when in sorted(rows, key=lambda row: (row[4], row[2])):
            before = held.get((p, r))
            if before != price:
                jump = before is not None and (price >= 10 * before or 10 * price <= before)
                want.append((p, r, price, when, before, "new" if before is None else "jump" if jump else "changed"))
                held[p, r] = before if jump else price
        stream = jobs.start_price_changes(spark.readStream.schema(STAGED).parquet(source), out, checkpoint, current, buckets=8)
        stream.awaitTermination()
        assert max(o["numRowsTotal"] for progress in stream.recentProgress for o in progress["stateOperators"]) <= 8
    got = spark.read.schema(jobs.CHANGES).parquet(out)
    assert Counter(want) == Counter((r[0], r[1], r[2], r[4], r[5], r[6]) for r in got.collect())
    land(spark, source, [("p1", 5)], 3)
    with pytest.raises(Exception, match="8 buckets"):
        again = jobs.start_price_changes(spark.readStream.schema(STAGED).parquet(source), out, checkpoint, current, buckets=1)
        again.awaitTermination()
