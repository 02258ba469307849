"""Streams of landed pages: price changes by keyed state, publishing per micro-batch, and an abort gate.

A batch run over the same pages gives the same tables; every write is keyed by the micro-batch, so a restart repeats
a batch without changing the result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from larder import fixed
from larder.operators import prices as pr
from larder.sources.versions import BUCKETS, Versions

# Keyed state with an initial state needs the store that can hold more than memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = (
    "store_product_id string, region_code string, price_cop int, list_price_cop int, captured_at timestamp,"
    " previous_cop int, decision string"
)
_NAMES = [part.strip().split(" ")[0] for part in CHANGES.split(",")]


#: Hash buckets of (product, region) that keyed state is held in, some thousands of keys each; fixed for a checkpoint.
STATE_BUCKETS = 4096
_BUCKET = "bucket"
_KEY = ["store_product_id", "region_code"]


def state_buckets(rows: int) -> int:
    """Buckets of state for a history of ``rows`` snapshots: at most some four thousand keys in each."""
    return max(64, -(-rows // 4096))


class PriceChanges(StatefulProcessor):
    """Value state per bucket of (product, region): the last accepted prices of its keys, as one Arrow table.

    A jump is reported and never remembered. A call reads and writes the state of many keys at once, so a key costs no trip
    to the state store of its own.
    """

    def __init__(self, buckets: int):
        self.buckets = buckets

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("prices", "buckets int, prices binary")

    def _read(self) -> dict[tuple, int]:
        if not self.state.exists():
            return {}
        buckets, prices = self.state.get()
        if buckets != self.buckets:
            raise ValueError(f"the checkpoint holds {buckets} buckets of prices, not {self.buckets}")
        products, regions, held = (c.to_pylist() for c in pa.ipc.open_stream(bytes(prices)).read_all().columns)
        return dict(zip(zip(products, regions, strict=True), held, strict=True))

    def _write(self, prices: dict[tuple, int]) -> None:
        products, regions = zip(*prices, strict=True)
        columns = [pa.array(products, pa.string()), pa.array(regions, pa.string()), pa.array(prices.values(), pa.int32())]
        table, out = pa.table(columns, names=[*_KEY, "price_cop"]), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.state.update((self.buckets, out.getvalue().to_pybytes()))

    @staticmethod
    def _keys(rows: pd.DataFrame) -> Iterator[tuple]:
        return zip(*(rows[c].where(rows[c].notna(), None) for c in _KEY), strict=True)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        if len(initialState):  # a bucket's prices may come in several pieces
            self._write(self._read() | dict(zip(self._keys(initialState), initialState["price_cop"].astype("int64").tolist(), strict=True)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._read()
        # a bucket's rows of one micro-batch may come in several pieces and in any order: they are put in order of time together
        rows = pd.concat(list(rows)).sort_values(["captured_at", "price_cop"])
        if not len(rows):
            return
        at, before, decisions = [], [], []
        for n, (of, price) in enumerate(zip(self._keys(rows), rows["price_cop"].astype("int64").tolist(), strict=True)):
            previous = held.get(of)
            if previous == price:
                continue
            jump = previous is not None and (price >= previous * fixed.PRICE_JUMP or price * fixed.PRICE_JUMP <= previous)
            at.append(n)
            before.append(previous)
            decisions.append("new" if previous is None else "jump" if jump else "changed")
            if not jump:
                held[of] = price
        if at:
            frame = rows.iloc[at].assign(previous_cop=pd.array(before, "Int64"), decision=decisions)
            frame["list_price_cop"] = frame["list_price_cop"].astype("Int64")
            yield frame[_NAMES]
            if decisions.count("jump") < len(at):
                self._write(held)

    def close(self) -> None:
        pass


def price_change_stream(staged: DataFrame, current: DataFrame | None = None, buckets: int = STATE_BUCKETS) -> DataFrame:
    """Snapshots to append, and refused jumps, as prices stream in (store_product_id, region_code, price_cop,
    list_price_cop, captured_at). ``current`` seeds the state with the published prices.

    Rows of one key are taken micro-batch by micro-batch, and by time inside each one. Keys are dealt into ``buckets`` by
    hash, whose number stays for the life of a checkpoint; the state is one number per key. A task holds one bucket's prices
    and its rows of one micro-batch, whose size the source's trigger options bound.
    """
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(buckets)).cast("int").alias(_BUCKET)
    start = current.select(bucket, *_KEY, "price_cop").groupBy(_BUCKET) if current is not None else None
    columns = [*_KEY, "price_cop", "list_price_cop", "captured_at"]
    return staged.select(bucket, *columns).groupBy(_BUCKET).transformWithStateInPandas(
        statefulProcessor=PriceChanges(buckets),
        outputStructType=CHANGES,
        outputMode="Append",
        timeMode="None",
        initialState=start,
    )


def start_price_changes(
    staged: DataFrame, out: str, checkpoint: str, current: DataFrame | None = None, buckets: int = STATE_BUCKETS
) -> StreamingQuery:
    """Run the detector over what is landed, writing changes as parquet; restart with the same checkpoint and ``buckets``."""
    return (
        price_change_stream(staged, current, buckets)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _version(path: str, batch_id: int) -> str:
    return os.path.join(path, f"batch={batch_id:09d}")


def publish_batches(
    snapshots: DataFrame,
    current_path: str,
    checkpoint: str,
    seed: DataFrame,
    merge: Callable[[DataFrame, DataFrame], DataFrame] = pr.publish,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Progressive publish: after each micro-batch of snapshots, a new version of the current prices (``sources.versions``).

    Version ``n + 1`` is built from version ``n`` and batch ``n`` and writes the buckets of the batch's products only, so running
    a batch again gives the same version. ``pr.publish_rows`` over a seed with ids takes batches in any order, also with equal times.
    """
    table = Versions(snapshots.sparkSession, current_path)
    table.create(seed, ["store_product_id"], buckets)
    publish = lambda batch, batch_id: table.commit(batch_id + 1, batch, merge)
    return (
        snapshots.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def published(spark: SparkSession, current_path: str, last_batch: int | None = None) -> DataFrame:
    """Prices as published after a batch, the last one by default; -1 is the seed."""
    return Versions(spark, current_path).read(None if last_batch is None else last_batch + 1)


class AbortGate:
    """Running share of unreadable records per store. Rows written before a store trips stay written.

    Counters are one row per store and batch in ``path``, so a restarted query picks them up again.
    """

    def __init__(self, spark: SparkSession, path: str, minimum: int = fixed.MIN_SAMPLE, limit: float = fixed.MAX_UNREADABLE_SHARE):
        self.spark, self.path, self.minimum, self.limit = spark, path, minimum, limit

    def add(self, staged: DataFrame, batch_id: int) -> None:
        staged.groupBy("store").agg(
            F.count(F.lit(1)).alias("seen"), F.count_if(F.col("status") == "failed").alias("failed")
        ).write.mode("overwrite").parquet(_version(self.path, batch_id))

    def tripped(self) -> DataFrame:
        """Stores over the limit so far."""
        totals = self.spark.read.parquet(self.path).groupBy("store").agg(F.sum("seen").alias("seen"), F.sum("failed").alias("failed"))
        return totals.where((F.col("seen") >= self.minimum) & (F.col("failed") / F.col("seen") > self.limit))


def write_until_aborted(
    staged: DataFrame, out: str, checkpoint: str, gate: AbortGate, stop_all: bool = True
) -> StreamingQuery:
    """Write readable rows per micro-batch and drop the stores that tripped; stop when every store of a batch has."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            gate.add(batch, batch_id)
            over = gate.tripped().select("store")
            kept = batch.where("status = 'ok'").join(over, "store", "left_anti")
            kept.write.mode("overwrite").parquet(_version(out, batch_id))
            alive = batch.select("store").distinct().join(over, "store", "left_anti")
            if stop_all and alive.isEmpty() and not batch.isEmpty():
                raise StoreAborted(f"every store of batch {batch_id} is over the unreadable limit")
        finally:
            batch.unpersist()

    return (
        staged.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class StoreAborted(RuntimeError):
    """The unreadable share tripped; what was written before stays."""
