"""Saves of ordinary lists followed one by one: a task reads a list's rows in order and holds one list's state at a time.

Lists with more saves than a task should follow do not come here, see ``lists.apply_list_saves``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of rows in: what a list holds at first, what a save wants, the save itself (behind its entries).
HELD, ENTRY, SAVE = 0, 1, 2
#: Kinds of rows out: a save with its error, an item of a list in the end, the last accepted save of a list.
VERDICT, ITEM, LAST = 0, 1, 2
#: Columns that are handed on as they came.
KEPT = ["list_id", "store_product_id", "quantity", "position", "row"]


def _listed(column: pa.Array) -> list:
    """The values of a column, nulls as None; whole numbers, strings and flags without a scalar object for each."""
    kind = column.type
    if pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    if not (pa.types.is_integer(kind) or pa.types.is_boolean(kind)):
        return column.to_pylist()
    values = column.fill_null(False if pa.types.is_boolean(kind) else 0).to_numpy(zero_copy_only=False)
    if column.null_count:
        values = values.astype(object)
        values[column.is_null().to_numpy(zero_copy_only=False)] = None
    return values.tolist()


class _Replay:
    """State of the list that is being read, and the rows to hand on."""

    def __init__(self, schema: pa.Schema):
        self.schema = pa.schema([schema.field(c) for c in KEPT] + [("out", pa.int32()), ("error", pa.string()), ("price", pa.int64())])
        self.open = False
        self._begin(None)

    def _begin(self, list_id) -> None:
        self.list_id, self.held, self.born = list_id, {}, None
        self.state: set | None = None  # products of the last accepted save; before it, what is held at a price
        self.frozen: dict = {}
        self.items: list[tuple[int, int | None]] = []  # the last accepted save's rows in this batch with their prices, or held rows
        self.last: int | None = None
        self.before: list[pa.RecordBatch] = []  # the same of batches that are gone
        self.accepted = False

    def _rows(self, rows: pa.RecordBatch, at: list[int], out: list[int], error: list, price: list) -> pa.RecordBatch:
        kept = rows.select(KEPT).take(pa.array(at, pa.int64()))
        more = [pa.array(out, pa.int32()), pa.array(error, pa.string()), pa.array(price, pa.int64())]
        return pa.RecordBatch.from_arrays([*kept.columns, *more], schema=self.schema)

    def feed(self, rows: pa.RecordBatch, final: bool) -> tuple[list[pa.RecordBatch], pa.RecordBatch | None]:
        """Rows to hand on, and the rows of a save that may not be complete."""
        lists, kinds, seqs, ids, products, prices, outside = (
            _listed(rows.column(c)) for c in ("list_id", "kind", "seq", "save_id", "store_product_id", "price", "outside"))
        codes, news, owners, there = (_listed(rows.column(c)) for c in ("code", "is_new", "owner_id", "there"))
        gone: list[pa.RecordBatch] = []
        at, out, error, price = [], [], [], []

        def put(i: int, kind: int, code, cost) -> None:
            at.append(i)
            out.append(kind)
            error.append(code)
            price.append(cost)

        def close() -> None:
            # items of a list without a name are never matched with its last save: what it held stays, nothing is added
            gone.extend(self.before)
            if self.list_id is not None or not self.accepted:
                for i, cost in self.items:
                    put(i, ITEM, None, cost)
            if self.last is not None:
                put(self.last, LAST, None, None)

        def judge(start: int, end: int) -> None:
            entries: dict = {}
            held, bad, hopeless, first = self.held, False, False, end
            for i in range(start, end):
                if kinds[i] == SAVE:
                    first = i
                    break
                p, today = products[i], prices[i]
                bad = bad or outside[i]
                if today is None:
                    hopeless = hopeless or p not in held or None in held[p]
                if p not in entries or today is None:
                    entries[p] = (i, today)
            good, errors = 0, []
            for i in range(first, end):
                code = codes[i]
                if code is None:
                    code = "22003" if bad or not entries else "P0001" if hopeless else None
                if code is None and news[i]:
                    if self.born is None or (self.born[0] == seqs[i] and owners[i] < self.born[1]):
                        self.born = (seqs[i], owners[i])
                if code in (None, "P0001") and news[i] is False and not there[i]:
                    born = self.born
                    if born is None or born[0] is None or seqs[i] is None or not (born[0] < seqs[i] and born[1] == owners[i]):
                        code = "P0002"
                good += code is None
                errors.append(code)
            late = False
            if good:
                has = self.state
                if has is None:
                    has = {p for p, costs in held.items() if any(c is not None for c in costs)}
                late = any(today is None and p not in has for p, (_, today) in entries.items())
                if not late:
                    if not self.accepted and self.list_id is None:
                        for i, cost in self.items:
                            put(i, ITEM, None, cost)
                    elif not self.accepted:
                        self.frozen = {p: max((c for c in costs if c is not None), default=None) for p, costs in held.items()}
                    frozen, begins = self.frozen, self.state is None
                    for p, (_, today) in entries.items():
                        if today is not None and (p not in has or (begins and None in held[p])):
                            frozen[p] = today
                    self.items = [(i, frozen.get(p)) for p, (i, _) in entries.items()]
                    if self.list_id is None and not self.accepted:
                        gone.extend(self.before)
                    self.state, self.accepted, self.before = set(entries), True, []
                    self.last = first + errors.index(None)
            for i, code in enumerate(errors, first):
                for _ in range(good if late else 1):
                    put(i, VERDICT, "P0001" if late and code is None else code, None)

        n, i, rest = rows.num_rows, 0, None
        while i < n:
            if not self.open or lists[i] != self.list_id:
                if self.open:
                    close()
                self._begin(lists[i])
                self.open = True
            if kinds[i] == HELD:
                self.held.setdefault(products[i], []).append(prices[i])
                self.items.append((i, prices[i]))
                i += 1
                continue
            end = i + 1
            while end < n and kinds[end] != HELD and ids[end] == ids[i] and seqs[end] == seqs[i] and lists[end] == lists[i]:
                end += 1
            if end == n and not final:
                rest = rows.slice(i)
                break
            judge(i, end)
            i = end
        if final and self.open:
            close()
            self._begin(None)
            self.open = False
        elif self.items or self.last is not None:
            keep = [(i, ITEM, cost) for i, cost in self.items if self.list_id is not None or not self.accepted]
            keep += [(self.last, LAST, None)] if self.last is not None else []
            self.before.append(self._rows(rows, [k[0] for k in keep], [k[1] for k in keep], [None] * len(keep), [k[2] for k in keep]))
            self.items, self.last = [], None
        return [*gone, self._rows(rows, at, out, error, price)], rest


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    replay, rest, schema = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = batch.schema
        replay = replay or _Replay(schema)
        rows = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        out, rest = replay.feed(rows, False)
        yield from out
    if replay is not None:
        yield from replay.feed(rest if rest is not None else pa.RecordBatch.from_pylist([], schema), True)[0]


def replay_saves(saves: DataFrame, entries: DataFrame, held: DataFrame) -> DataFrame:
    """Follow the saves of each list in order; rows by ``out``: verdicts, items in the end, last accepted saves.

    ``saves``: list_id, seq, save_id, owner_id, is_new, code (an error that the save has by itself), there (its list is the
    owner's) and a struct ``row``, handed on. ``entries``: list_id, seq, save_id, store_product_id, quantity, position,
    outside, price (today's). ``held``: list_id, store_product_id, quantity, position, price (when added).
    """
    line = saves.withColumn("kind", F.lit(SAVE))
    line = line.unionByName(entries.withColumn("kind", F.lit(ENTRY)), allowMissingColumns=True)
    line = line.unionByName(held.withColumn("kind", F.lit(HELD)), allowMissingColumns=True)
    line = line.repartition("list_id").sortWithinPartitions("list_id", F.col("kind") != HELD, "seq", "save_id", "kind")
    kept = ", ".join(f"{c} {line.schema[c].dataType.simpleString()}" for c in KEPT)
    return line.mapInArrow(_replayed, f"{kept}, out int, error string, price long")
