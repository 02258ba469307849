"""Bucketed versions: bytes follow the batch, a commit repeats without effect, old versions stay readable until vacuumed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from larder.operators import prices as pr
from larder.sources.versions import Versions, buckets_for
from larder.streaming import jobs

SNAPSHOT = "id long, store_product_id string, region_code string, price_cop int, list_price_cop int, captured_at timestamp"


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


def snapshots(spark, rows):
    """(id, product, price, day) as snapshots of one region."""
    frame = spark.createDataFrame([(i, p, "NACIONAL", c, None, d) for i, p, c, d in rows], SNAPSHOT.replace("captured_at timestamp", "day int"))
    return frame.select(*frame.columns[:5], F.date_add(F.lit("2026-01-01").cast("date"), F.col("day")).cast("timestamp").alias("captured_at"))


def seeded(spark, path, n=20_000):
    table = Versions(spark, str(path))
    rows = spark.range(n).select(
        "id", F.col("id").cast("string").alias("store_product_id"), F.lit("NACIONAL").alias("region_code"),
        (F.col("id") % 977).cast("int").alias("price_cop"), F.lit(None).cast("int").alias("list_price_cop"),
        F.lit("2026-01-01").cast("timestamp").alias("captured_at"),
    )
    table.create(rows, ["store_product_id"])
    return table


def prices(df):
    return {r.store_product_id: r.price_cop for r in df.collect()}


def test_a_commit_writes_the_buckets_of_its_rows(spark, tmp_path):
    table = seeded(spark, tmp_path)
    table.commit(1, snapshots(spark, [(99_999, "7", 5, 3), (99_998, "new", 6, 3)]), pr.publish_rows)
    before, after = table.manifest(0)["held"], table.manifest(1)["held"]
    moved = {b for b, v in after.items() if v == 1}
    assert len(before) == len(after) == 64 and 1 <= len(moved) <= 2
    assert size(f"{tmp_path}/data/version=000000001") < size(f"{tmp_path}/data/version=000000000") / 10
    assert table.latest() == 1 and table.read().count() == 20_001
    assert prices(table.read().where("store_product_id in ('7', '8', 'new')")) == {"7": 5, "8": 8, "new": 6}
    assert prices(table.read(0).where("store_product_id in ('7', 'new')")) == {"7": 7}


def test_number_of_buckets():
    assert [buckets_for(n) for n in (0, 16_000_001, 10**12)] == [8, 9, 4096]


def test_a_commit_that_is_repeated_or_was_broken_off(spark, tmp_path):
    table = seeded(spark, tmp_path, 100)
    # a run that died before its manifest leaves files that nobody reads and the next one writes over
    snapshots(spark, [(500, "7", 1, 1)]).withColumn("bucket", F.lit(3)).write.partitionBy("bucket").parquet(f"{tmp_path}/data/version=000000001")
    assert table.latest() == 0 and table.read().count() == 100
    batch = snapshots(spark, [(501, "7", 2, 1)])
    table.commit(1, batch, pr.publish_rows)
    first = open(f"{tmp_path}/manifests/000000001.json").read()
    table.commit(1, batch, pr.publish_rows)
    assert open(f"{tmp_path}/manifests/000000001.json").read() == first and table.read().count() == 100
    assert prices(table.read().where("store_product_id = '7'")) == {"7": 2}
    table.create(batch, ["store_product_id"])
    assert table.read(0).count() == 100 and "held" in json.loads(first)


def test_empty_batches_null_keys_and_rows_that_go(spark, tmp_path):
    table = Versions(spark, str(tmp_path))
    table.create(snapshots(spark, []), ["store_product_id"], 4)
    assert table.read().count() == 0 and table.manifest()["held"] == {}
    table.commit(1, snapshots(spark, []), pr.publish_rows)
    assert table.latest() == 1 and table.read().count() == 0
    table.commit(2, snapshots(spark, [(1, None, 10, 1), (2, "a", 20, 1), (2, "a", 20, 1)]), pr.publish_rows)
    assert prices(table.read()) == {None: 10, "a": 20} and table.read().count() == 2
    table.commit(3, snapshots(spark, [(3, None, 11, 2)]), pr.publish_rows)
    assert prices(table.read()) == {None: 11, "a": 20}
    table.commit(4, snapshots(spark, [(4, "a", 0, 3)]), lambda rows, gone: rows.join(gone, "store_product_id", "left_anti"))
    assert prices(table.read()) == {None: 11}
    with pytest.raises(ValueError):
        Versions(spark, f"{tmp_path}/other").create(spark.range(3).withColumnRenamed("id", "bucket"), ["bucket"])


def test_vacuum_keeps_what_the_last_versions_hold(spark, tmp_path):
    table = seeded(spark, tmp_path, 500)
    for n in range(1, 5):
        table.commit(n, snapshots(spark, [(1000 + n, "7", n, n)]), pr.publish_rows)
    last, before = prices(table.read()), prices(table.read(3))
    table.vacuum(2)
    assert prices(table.read()) == last and prices(table.read(3)) == before and last["7"] == 4
    assert len(os.listdir(f"{tmp_path}/data/version=000000001")) <= 2  # its only bucket is gone, the marker of its job stays


def test_batches_in_any_order_publish_the_same_prices(spark, tmp_path):
    """Equal times over several batches: the higher id wins wherever it comes."""
    rows = [(n, f"p{n % 5}", 100 + n, n // 20) for n in range(60)]
    want = prices(pr.latest_price(snapshots(spark, rows)))
    for name, order in (("up", rows), ("down", rows[::-1])):
        source = f"{tmp_path}/{name}/in"
        for k in range(0, 60, 15):
            snapshots(spark, order[k : k + 15]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", 1).parquet(source)
        at = f"{tmp_path}/{name}/current"
        for _ in range(2):  # the second start finds nothing new and keeps the seed as it is
            query = jobs.publish_batches(stream, at, f"{tmp_path}/{name}/checkpoint", snapshots(spark, []), pr.publish_rows, 4)
            query.awaitTermination()
        assert Versions(spark, at).latest() == 4
        assert prices(jobs.published(spark, at)) == want and jobs.published(spark, at, -1).count() == 0
