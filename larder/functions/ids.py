"""Deterministic ids, so a repeated run writes the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(*parts: Column) -> Column:
    """UUID-shaped id from the natural key."""
    digest = F.md5(F.to_json(F.array(*[p.cast("string") for p in parts])))
    pieces = [F.substring(digest, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *pieces)
