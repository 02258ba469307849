"""Which saves of a list are accepted when each depends on the accepted save just before it.

A save that needs nothing is always accepted. One that keeps products without a price today needs them in the list as
the accepted save before it left it. Only lists with such saves come here, with the products that any of them needs.

What a slice of a list's saves does to the list is a short table. Whatever the list held, the first save accepted is
the first one whose needs it meets, and from there on all is settled. A save that needs no less than an earlier one of
the slice is never first, so the table has a row for each save that isn't ruled out like that; it ends at a save
without needs. Tables compose, so slices run as tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ordered import SLICE, TARGET_ROWS, in_slices

#: Columns of a save: what it needs, and what it has of the products that any save of its list needs.
SAVE = ["save_id", "list_id", "seq", "needs", "has"]
_STARTS = pa.list_(pa.struct([("needs", pa.list_(pa.string())), ("has", pa.list_(pa.string()))]))


class _Table:
    """What a slice does: for each save that can be the first accepted one, its needs and what the list has in the end."""

    def __init__(self):
        self.needs: list[frozenset] = []
        self.ends: dict[frozenset, list[int]] = {}

    def add(self, needs: frozenset, has: frozenset) -> None:
        moved = [state for state in self.ends if needs <= state and state != has]
        for state in moved:
            here, there = self.ends.pop(state), self.ends.get(has, [])
            self.ends[has] = here + there if len(here) < len(there) else there + here
        if not any(earlier <= needs for earlier in self.needs):
            self.ends.setdefault(has, []).append(len(self.needs))
            self.needs.append(needs)

    def rows(self) -> list[dict]:
        end = {k: state for state, starts in self.ends.items() for k in starts}
        return [{"needs": sorted(needs), "has": sorted(end[k])} for k, needs in enumerate(self.needs)]


def _part_schema(batch: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.Schema:
    return pa.schema([batch.schema.field("list_id"), (SLICE, pa.int32()), (name, kind)])


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of every slice; rows are saves in order."""
    at, table, schema = None, _Table(), None
    for batch in batches:
        out, schema = [], _part_schema(batch, "starts", _STARTS)
        for row in batch.select(["list_id", SLICE, "needs", "has"]).to_pylist():
            if at != (row["list_id"], row[SLICE]):
                if at is not None:
                    out.append({"list_id": at[0], SLICE: at[1], "starts": table.rows()})
                at, table = (row["list_id"], row[SLICE]), _Table()
            table.add(frozenset(row["needs"]), frozenset(row["has"]))
        yield pa.RecordBatch.from_pylist(out, schema)
    if at is not None:
        yield pa.RecordBatch.from_pylist([{"list_id": at[0], SLICE: at[1], "starts": table.rows()}], schema)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a list has when each of its slices begins; rows are tables in order, with what the list ``held`` at first."""
    at, state = (), frozenset()
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if at != (row["list_id"],):
                at, state = (row["list_id"],), frozenset(row["held"])
            out.append({"list_id": row["list_id"], SLICE: row[SLICE], "entry": sorted(state)})
            state = next((frozenset(s["has"]) for s in row["starts"] if state.issuperset(s["needs"])), state)
        yield pa.RecordBatch.from_pylist(out, _part_schema(batch, "entry", pa.list_(pa.string())))


def _refused(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Saves that are refused; rows are saves in order, behind a row with what the list has when their slice begins."""
    state = frozenset()
    for batch in batches:
        out = []
        for row in batch.select(["kind", "save_id", "needs", "has"]).to_pylist():
            if row["kind"] == 0 or state.issuperset(row["needs"]):
                state = frozenset(row["has"])
            else:
                out.append({"save_id": row["save_id"]})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("save_id")]))


def refused_saves(saves: DataFrame, held: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """``save_id`` of the saves that need what the list no longer has.

    ``saves``: save_id, list_id, seq (a number), needs and has (arrays of products, ``has`` includes ``needs``).
    ``held``: list_id and the array ``held``, what the list has at first; a list without a row has nothing. A list of more
    than ``target_rows`` saves is cut into slices by ``seq``. Saves stream through tasks; one list's state is held at a time.
    """
    types = {c: saves.schema[c].dataType.simpleString() for c in ("list_id", "save_id")}
    part = f"list_id {types['list_id']}, {SLICE} int"
    saves = saves.select(*SAVE)
    nothing = F.array().cast("array<string>")
    by_slice = ["list_id", SLICE]

    hot = in_slices(saves, ["list_id"], F.col("seq"), target_rows, only_hot=True)
    tables = hot.repartition(*by_slice).sortWithinPartitions(*by_slice, "seq", "save_id").mapInArrow(
        _tables, f"{part}, starts array<struct<needs: array<string>, has: array<string>>>"
    )
    first = tables.join(held, "list_id", "left").withColumn("held", F.coalesce("held", nothing))
    entries = first.repartition("list_id").sortWithinPartitions(*by_slice).mapInArrow(_along, f"{part}, entry array<string>")

    sliced = in_slices(saves, ["list_id"], F.col("seq"), target_rows)
    opened = sliced.select(*by_slice).distinct().join(held, "list_id", "left").join(entries, by_slice, "left")
    opened = opened.select(*by_slice, F.lit(0).alias("kind"), F.coalesce("entry", "held", nothing).alias("has"))
    line = sliced.withColumn("kind", F.lit(1)).unionByName(opened, allowMissingColumns=True)
    line = line.repartition(*by_slice).sortWithinPartitions(*by_slice, "kind", "seq", "save_id")
    return line.mapInArrow(_refused, f"save_id {types['save_id']}")
