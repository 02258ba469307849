"""Trips: position fixes matched to planned routes, off-route triggers, arrivals, bounds.

``routes``: route_id, coordinates (array of struct lng, lat), distance_m, duration_s. ``fixes``: trip_id, route_id, ts, lat, lng.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder import fixed
from larder.functions import geo
from larder.functions.ordered import SLICE, TARGET_ROWS, in_slices, previous_row, running_total
from larder.operators.follow import (
    RUN,
    RerouteMap,
    Routes,
    after_slice,
    distant_runs,
    reroutes,
    segments_along,
    transitions,
)


def _leg(a: Column, b: Column) -> Column:
    return geo.haversine_m(a["lat"], a["lng"], b["lat"], b["lng"])


def route_segments(routes: DataFrame) -> DataFrame:
    """Consecutive vertex pairs with their length and the metres left from the segment's start to the route's end.

    A route's vertices are one row's array, so the suffix sum is worked out inside the row and nothing is shuffled.
    """
    points = F.col("coordinates")
    starts = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    lengths = F.transform(starts, lambda p, i: _leg(p, F.get(points, i + 1)))
    # walked from the end, each step puts its own sum in front
    tails = F.aggregate(
        F.reverse(F.col("lengths")),
        F.array().cast("array<double>"),
        lambda sums, m: F.concat(F.array(m + F.coalesce(F.get(sums, F.lit(0)), F.lit(0.0))), sums),
    )
    return (
        routes.withColumn("lengths", lengths)
        .withColumn("tails", tails)
        .select("route_id", "coordinates", F.posexplode("lengths").alias("segment", "length_m"), "tails")
        .select(
            "route_id",
            "segment",
            F.get("coordinates", F.col("segment")).alias("a"),
            F.get("coordinates", F.col("segment") + 1).alias("b"),
            "length_m",
            F.get("tails", F.col("segment")).alias("remaining_m"),
        )
    )


def remaining_along(points: DataFrame, keys: list[str], at: Column, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The same for vertices that come as rows (keys, ``at``, lat, lng): length to the next one and metres to the end.

    Works from the end backwards in slices, so a route with a third of all vertices is not one task's work.
    """
    order = [-at, F.col("lat"), F.col("lng")]
    stepped = previous_row(points, keys, order, -at, ["lat", "lng"], "_next", target_rows)
    leg = F.coalesce(geo.haversine_m(F.col("lat"), F.col("lng"), F.col("_next.lat"), F.col("_next.lng")), F.lit(0.0))
    measured = stepped.withColumn("length_m", leg).drop("_next")
    return running_total(measured, keys, order, -at, F.col("length_m"), "remaining_m", target_rows)


def route_bounds(routes: DataFrame) -> DataFrame:
    """West, south, east and north of every route."""
    lng, lat = F.transform("coordinates", lambda p: p["lng"]), F.transform("coordinates", lambda p: p["lat"])
    return routes.select(
        "route_id", F.array_min(lng).alias("west"), F.array_min(lat).alias("south"), F.array_max(lng).alias("east"),
        F.array_max(lat).alias("north"),
    )


def arrivals(fixes: DataFrame, shops: DataFrame, within_m: float = fixed.ARRIVAL_M) -> DataFrame:
    """First fix of each trip within 30 m of its shop (trip_id, shop_lat, shop_lng), not of the route's end."""
    metres = geo.haversine_m(F.col("lat"), F.col("lng"), F.col("shop_lat"), F.col("shop_lng"))
    return fixes.join(shops, "trip_id").where(metres <= within_m).groupBy("trip_id").agg(F.min("ts").alias("arrived_at"))


def off_route_runs(
    matched: DataFrame, key: str, order: list[Column], at: Column, distance: str = "off_route_m",
    limit_m: float = fixed.OFF_ROUTE_M, target_rows: int = TARGET_ROWS,
) -> DataFrame:
    """Add ``off_route``: this fix and the two before it are all further off than the limit."""
    once = previous_row(matched, [key], order, at, [distance], "_one", target_rows)
    twice = previous_row(once, [key], order, at, ["_one"], "_two", target_rows)
    far = lambda c: F.coalesce(c > limit_m, F.lit(False))
    run = far(F.col(distance)) & far(F.col(f"_one.{distance}")) & far(F.col(f"_two._one.{distance}"))
    return twice.withColumn("off_route", run).drop("_one", "_two")


MATCHED = (
    "trip_id string, route_id string, ts timestamp, lat double, lng double, segment int, off_route_m bigint,"
    " remaining_m bigint, remaining_s bigint, reroute boolean"
)
TRIP = ["trip_id", "route_id"]
PART = f"trip_id string, route_id string, {SLICE} int"


def _arrays(lists: pa.ListArray) -> list[np.ndarray | None]:
    flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().fill_null(0).to_numpy()).tolist()
    return [flat[a:b] if there else None for a, b, there in zip([0, *ends], ends, lists.is_valid().to_pylist(), strict=False)]


class _Batch:
    """Sorted rows of one Arrow batch. Each slice of a trip is opened by a row with its route and the state it begins in;
    ``before`` is the slice that the last batch ended in."""

    def __init__(self, batch: pa.RecordBatch, before: dict | None):
        opening = batch.column("kind").to_numpy() == 0
        opened, fixes = batch.filter(pa.array(opening)), batch.filter(pa.array(~opening))
        names, points = [*TRIP, SLICE, "pace", "segment", "run", "since"], ("route_lat", "route_lng")
        columns = [opened.column(c).to_pylist() for c in names] + [_arrays(opened.column(c)) for c in points]
        self.slices = [] if before is None else [before]
        self.slices += [dict(zip([*names, *points], found, strict=True)) for found in zip(*columns, strict=True)]
        self.number = np.cumsum(opening)[~opening] - (before is None)
        self.rows = fixes.select([*TRIP, "ts", "lat", "lng"])
        known = np.array([s["route_lat"] is not None for s in self.slices], dtype=bool)
        lat, lng, us = (fixes.column(c) for c in ("lat", "lng", "us"))
        there = [np.asarray(c.is_valid()) for c in (lat, lng, us)]
        self.usable = known[self.number] & there[0] & there[1] & there[2] if len(self.number) else np.zeros(0, dtype=bool)
        values = [c.to_numpy(zero_copy_only=False)[self.usable] for c in (lat, lng)]
        self.usable[self.usable] = finite = np.isfinite(values[0]) & np.isfinite(values[1])
        self.lat, self.lng = values[0][finite], values[1][finite]
        self.us = us.fill_null(0).to_numpy()[self.usable]
        self.of = self.number[self.usable]
        self.opens = np.append(True, self.of[1:] != self.of[:-1])[: len(self.of)]
        empty = np.zeros(0)
        self.routes = Routes(*([empty if s[c] is None else s[c] for s in self.slices] for c in points)) if self.slices else None

    def _each(self, name: str) -> np.ndarray:
        return np.array([s[name] for s in self.slices])[self.of]

    def follow(self):
        """(segment, metres off, metres left) of the usable fixes; every slice then begins behind them."""
        at, off, left = segments_along(self.routes, self.of, self.lat, self.lng, self.opens, self._each("segment"))
        last = np.flatnonzero(np.append(self.opens[1:], True))
        for row in last[: len(self.of)]:
            self.slices[self.of[row]]["segment"] = int(at[row])
        return at, off, left

    def parts(self) -> Iterator[tuple[dict, int, slice]]:
        """(slice, its number, its usable fixes), also of slices without any."""
        bounds = np.searchsorted(self.of, np.arange(len(self.slices) + 1))
        for k, found in enumerate(self.slices):
            yield found, k, slice(int(bounds[k]), int(bounds[k + 1]))


def _whole_metres(off: np.ndarray) -> np.ndarray:
    return np.floor(off + 0.5).astype(np.int64)


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matched fixes of slices that know the state they begin in; only one slice's route and state are held between batches."""
    before = None
    for batch in batches:
        here = _Batch(batch, before)
        n = len(here.number)
        out = [np.zeros(n, dtype=np.int64) for _ in range(4)] + [np.zeros(n, dtype=bool)]
        if len(here.of):
            at, off, left = here.follow()
            off = _whole_metres(off)
            runs = distant_runs(off > fixed.OFF_ROUTE_M, here.opens, here._each("run"))
            asked, last = np.zeros(len(off), dtype=bool), -1
            ends = np.flatnonzero(runs > RUN)
            times = here.us.tolist() if len(ends) else []
            for mine in np.split(ends, np.flatnonzero(np.diff(here.of[ends])) + 1) if len(ends) else []:
                found = here.slices[here.of[mine[0]]]
                places = reroutes(mine.tolist(), times, found["since"], -1 - RUN)
                if places:
                    asked[places] = True
                    found["since"] = times[places[-1]]
                    last = places[-1] if found is here.slices[here.of[-1]] else last
            # only the slice that the last fix is in may go on in the next batch
            here.slices[here.of[-1]]["run"] = min(RUN, int(runs[-1]), len(off) - 1 - last)
            values = (at, off, _whole_metres(left), _whole_metres(left * here._each("pace")), asked)
            for whole, value in zip(out, values, strict=True):
                whole[here.usable] = value
        types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        found = [pa.array(value, type=t, mask=~here.usable) for value, t in zip(out, types, strict=True)]
        names = [part.strip().split(" ")[0] for part in MATCHED.split(",")]
        yield pa.RecordBatch.from_arrays([*here.rows.columns, *found], names)
        before = here.slices[-1] if here.slices else None


def _summaries(begin, add, result, names: list[str]):
    """A step that sums up every slice: ``begin`` at its opening row, ``add`` with the fixes of a batch, ``result`` at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, out = None, []
        row = lambda s: dict({c: s[c] for c in (*TRIP, SLICE)}, **result(s["sum"]))
        for batch in batches:
            here = _Batch(batch, before)
            matched = here.follow() if names[-1] == "tails" and len(here.of) else None
            for found, k, rows in here.parts():
                if "sum" not in found:
                    found["sum"] = begin(here.routes, k)
                if rows.stop > rows.start:
                    found["sum"] = add(found["sum"], here, k, rows, matched)
            ended, before = here.slices[:-1], here.slices[-1] if here.slices else None
            out.extend(row(s) for s in ended)
            if out:
                yield pa.RecordBatch.from_pylist(out, _SUMMARY[names[-1]])
                out = []
        if before is not None:
            yield pa.RecordBatch.from_pylist([row(before)], _SUMMARY[names[-1]])

    return run


_PART = [("trip_id", pa.string()), ("route_id", pa.string()), (SLICE, pa.int32())]
_START = pa.struct([("run", pa.int32()), ("us", pa.int64()), ("last_run", pa.int32()), ("last_us", pa.int64())])
_SUMMARY = {
    "table": pa.schema([*_PART, ("table", pa.list_(pa.int32()))]),
    "tails": pa.schema([*_PART, ("starts", pa.list_(_START)), ("tails", pa.list_(pa.int32()))]),
}


def _add_segments(table, here: _Batch, k: int, rows: slice, matched):
    return transitions(here.routes, k, here.lat[rows], here.lng[rows], table)


def _add_runs(found: RerouteMap, here: _Batch, k: int, rows: slice, matched):
    found.add(_whole_metres(matched[1][rows]) > fixed.OFF_ROUTE_M, here.us[rows])
    return found


def _starts(found: RerouteMap) -> dict:
    starts = [
        {"run": run, "us": us, "last_run": last_run, "last_us": last_us}
        for (run, us), (last_run, last_us) in zip(found.starts, found.states, strict=True)
    ]
    return {"starts": starts, "tails": found.tails}


_segment_tables = _summaries(lambda routes, k: np.arange(int(routes.segments[k])), _add_segments, lambda t: {"table": t.tolist()}, ["table"])
_reroute_maps = _summaries(lambda routes, k: RerouteMap(), _add_runs, _starts, ["starts", "tails"])


def _entries(begin, step, names: list[str], schema: pa.Schema):
    """Sorted summaries of slices to the state each begins in: a state goes along a trip, one summary at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trip, state = None, begin
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if trip != (row["trip_id"], row["route_id"]):
                    trip, state = (row["trip_id"], row["route_id"]), begin
                out.append({c: row[c] for c in (*TRIP, SLICE)} | dict(zip(names, state, strict=True)))
                state = step(row, *state)
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


_segment_entries = _entries((0,), lambda row, at: (row["table"][at] if row["table"] else 0,), ["segment"], pa.schema([*_PART, ("segment", pa.int32())]))
_run_entries = _entries(
    (0, None), lambda row, run, since: after_slice(row["starts"], row["tails"], run, since), ["run", "since"],
    pa.schema([*_PART, ("run", pa.int32()), ("since", pa.int64())]),
)


def _on_part(df: DataFrame, state: DataFrame) -> DataFrame:
    """Join the state that slices begin in; it has at most two rows per ``target_rows`` fixes."""
    named = state.select(*[F.col(c).alias(f"_at_{c}") for c in (*TRIP, SLICE)], *state.columns[3:])
    same = F.lit(True)
    for c in (*TRIP, SLICE):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{c}"))
    return df.join(F.broadcast(named), same, "left").drop(*[f"_at_{c}" for c in (*TRIP, SLICE)])


def _lined_up(sliced: DataFrame, routes: DataFrame, *states: DataFrame) -> DataFrame:
    """Fixes of each slice in order behind a row with the slice's route and the state that it begins in."""
    opened = sliced.select(*TRIP, SLICE).distinct().join(routes, "route_id", "left")
    for state in states:
        opened = _on_part(opened, state)
    begin = {"segment": F.lit(0), "run": F.lit(0), "since": F.lit(None).cast("long")}
    for name, value in begin.items():
        opened = opened.withColumn(name, F.coalesce(name, value) if name in opened.columns else value)
    metres, seconds = F.col("distance_m").cast("double"), F.col("duration_s").cast("double")
    opened = opened.select(
        *TRIP, SLICE, F.lit(0).alias("kind"), *begin,
        F.transform("coordinates", lambda p: p["lat"]).alias("route_lat"),
        F.transform("coordinates", lambda p: p["lng"]).alias("route_lng"),
        F.coalesce(F.when(metres > 0, seconds / metres), F.lit(0.0)).alias("pace"),
    )
    line = opened.unionByName(sliced.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # a number given here is kept: adaptive coalescing sizes partitions by bytes and would starve the Python step
    tasks = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return line.repartition(tasks, *TRIP, SLICE).sortWithinPartitions(*TRIP, SLICE, "kind", "us", "lat", "lng")


def _in_turn(summaries: DataFrame) -> DataFrame:
    return summaries.repartition(*TRIP).sortWithinPartitions(*TRIP, SLICE)


def match_fixes(fixes: DataFrame, routes: DataFrame, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Segment, metres off the route, metres and seconds left, and whether to reroute, for every fix in time order.

    Each fix depends on the one before it, so a trip's fixes stream through a task in order, beside other trips'; the
    state between batches is one route and a few numbers. A trip of more than ``target_rows`` fixes is cut into slices
    of its time that run as tasks of their own: one pass over such trips gives a table for each slice (the segment it
    ends on, for each segment it may begin on), a second one what it does to distant runs and reroutes. Both compose, so
    going along a trip's slices gives the state each begins in. A slice's table has a number for each of its route's
    segments. Each route of a trip is followed by itself, with one row of ``routes`` per route_id. Fixes without a
    route, time or place come back with nulls and change nothing.
    """
    seen = fixes.select(*TRIP, "ts", "lat", "lng", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    hot = in_slices(seen, TRIP, F.col("us"), target_rows, only_hot=True)
    tables = _lined_up(hot, routes).mapInArrow(_segment_tables, f"{PART}, table array<int>")
    begun = _in_turn(tables).mapInArrow(_segment_entries, f"{PART}, segment int")
    starts = "array<struct<run: int, us: bigint, last_run: int, last_us: bigint>>"
    maps = _lined_up(hot, routes, begun).mapInArrow(_reroute_maps, f"{PART}, starts {starts}, tails array<int>")
    waiting = _in_turn(maps).mapInArrow(_run_entries, f"{PART}, run int, since bigint")
    sliced = in_slices(seen, TRIP, F.col("us"), target_rows)
    return _lined_up(sliced, routes, begun, waiting).mapInArrow(_match, MATCHED)
