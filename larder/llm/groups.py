"""Whole groups out of a stream of Arrow batches that are sorted by some key columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end where a group ends, with the edges of their groups; a group longer than a batch is carried on."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        edges = _edges(batch, keys)
        if rest and _edges(pa.Table.from_batches([rest[-1].slice(rest[-1].num_rows - 1), batch.slice(0, 1)]), keys)[1] == 1:
            yield _cut(rest, keys)
            rest = []
        if len(edges) == 2:
            rest.append(batch)
            continue
        yield _cut([*rest, batch.slice(0, edges[-2])], keys)
        rest = [batch.slice(edges[-2])]
    if rest:
        yield _cut(rest, keys)


def _cut(batches: list[pa.RecordBatch], keys: list[str]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    return table, _edges(table, keys)


def _edges(table, keys: list[str]) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        x = table.column(k).to_numpy() if isinstance(table, pa.Table) else table.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` items the first item that the links ``x - y`` lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        after = root.copy()
        np.minimum.at(after, x, low)
        np.minimum.at(after, y, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after
