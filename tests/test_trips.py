"""Fixes followed in slices and batches against a plain loop, one fix after the other."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder import fixed
from larder.operators import trips as tr
from larder.operators.follow import metres

ROUTES = "route_id string, coordinates array<struct<lng double, lat double>>, distance_m int, duration_s int"
FIXES = "trip_id string, route_id string, us long, lat double, lng double"


def nearest(line, lat, lng, start):
    best = None
    for s in range(start, len(line) - 1):
        (ax, ay), (bx, by) = line[s], line[s + 1]
        squeeze = math.cos(math.radians(lat))
        dx, dy = (bx - ax) * squeeze, by - ay
        square = dx * dx + dy * dy
        t = 0.0 if square == 0 else min(1.0, max(0.0, ((lng - ax) * squeeze * dx + (lat - ay) * dy) / square))
        py, px = ay + (by - ay) * t, ax + (bx - ax) * t
        off = float(metres(lat, lng, py, px))
        if best is None or off < best[0] - fixed.SEGMENT_TIE_M:
            rest = sum(float(metres(a[1], a[0], b[1], b[0])) for a, b in zip(line[s + 1 :], line[s + 2 :]))
            best = (off, float(metres(py, px, by, bx)) + rest, s)
    return best


def followed(line, pace, fixes):
    """The rows of one trip: a list of (us, lat, lng) in order gives (segment, off, metres left, seconds left, reroute)."""
    segment, recent, since, out = 0, [], None, []
    for us, lat, lng in fixes:
        if us is None or lat is None or lng is None:
            out.append((None,) * 5)
            continue
        found = nearest(line, lat, lng, segment)
        if found and segment > 0 and found[0] > fixed.OFF_ROUTE_M:
            found = min(found, nearest(line, lat, lng, 0), key=lambda x: x[0])
        if found is None:
            straight = float(metres(lat, lng, line[-1][1], line[-1][0])) if line else 0.0
            found = (straight, straight, 0)
        off, left, segment = found
        recent = [*recent, math.floor(off + 0.5)][-3:]
        waited = since is None or us - since >= fixed.REROUTE_PAUSE_MS * 1000
        reroute = waited and len(recent) == 3 and min(recent) > fixed.OFF_ROUTE_M
        if reroute:
            since, recent = us, []
        out.append((segment, math.floor(off + 0.5), math.floor(left + 0.5), math.floor(left * pace + 0.5), reroute))
    return out


def cases(seed=1, hot=400):
    """Routes that wind and come back, one of a vertex, one of none; trips that stray, pause, repeat places and lack values."""
    rng = np.random.default_rng(seed)
    lines = {"wind": [(-74 + 0.004 * math.sin(k / 3), 4.6 + 0.0008 * k) for k in range(30)], "point": [(-74.0, 4.6)], "none": []}
    lines["loop"] = [(-74 + 0.002 * math.cos(k), 4.6 + 0.002 * math.sin(k)) for k in range(13)]
    lines["twice"] = [(-74.0, 4.6), (-74.0, 4.6), (-73.999, 4.6), (-74.0, 4.6), (-73.998, 4.601)]
    fixes = []
    for trip, (route, n) in enumerate([("wind", hot), ("loop", hot), ("twice", 60), ("point", 20), ("none", 9), ("lost", 9), ("loop", 2), ("wind", 1)]):
        line = lines.get(route) or [(-74.0, 4.6)]
        us, far, bias = 1_700_000_000_000_000, False, 0.0
        for i in range(n):
            us += int(rng.choice([0, 1, 5, 10, 40])) * 1_000_000
            far = far != (rng.random() < 0.15)
            bias = 0.0007 * (1 + rng.random()) if far else 0.0
            at = line[min(len(line) - 1, int(i * len(line) / n))] if rng.random() < 0.9 else line[int(rng.integers(len(line)))]
            lat, lng = at[1] + bias + rng.normal() * 0.0001, at[0] + rng.normal() * 0.0001
            row = [f"t{trip}", route, us + len(fixes) % 7, float(lat), float(lng)]
            if rng.random() < 0.03:
                row[int(rng.integers(2, 5))] = None
            fixes.append(tuple(row))
    fixes += fixes[5:8] + [(None, "wind", 1_700_000_000_000_000, 4.6, -74.0), ("t0", "loop", 1_700_000_000_000_000, 4.6, -74.0)]
    return lines, fixes


def plain(lines, fixes):
    low = lambda x: (x is not None, x or 0)
    want, trips = [], {}
    for f in fixes:
        trips.setdefault(f[:2], []).append(f[2:])
    for (trip, route), rows in trips.items():
        rows.sort(key=lambda r: tuple(map(low, r)))
        found = followed(lines[route], 111 / 555, rows) if route in lines else [(None,) * 5] * len(rows)
        want += [(trip, route, *r, *x) for r, x in zip(rows, found, strict=True)]
    return sorted(want, key=str)


def run(spark, lines, fixes, **how):
    routes = spark.createDataFrame([(k, [{"lng": a, "lat": b} for a, b in v], 555, 111) for k, v in lines.items()], ROUTES)
    df = spark.createDataFrame(fixes, FIXES).withColumn("ts", F.timestamp_micros("us"))
    got = tr.match_fixes(df, routes, **how).withColumn("us", F.unix_micros("ts"))
    columns = ["trip_id", "route_id", "us", "lat", "lng", "segment", "off_route_m", "remaining_m", "remaining_s", "reroute"]
    return sorted([tuple(r) for r in got.select(columns).collect()], key=str)


@pytest.mark.parametrize(("target", "batch"), [(1_000_000, 10_000), (1_000_000, 7), (150, 10_000), (10, 5), (2, 3)])
def test_slices_and_batches_equal_a_plain_loop(spark, target, batch):
    lines, fixes = cases()
    want = plain(lines, fixes)
    assert sum(r[-1] is True for r in want) > 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert run(spark, lines, fixes, target_rows=target) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(2, 6))
def test_other_trips_in_slices(spark, seed):
    lines, fixes = cases(seed, hot=150)
    assert run(spark, lines, fixes, target_rows=9) == plain(lines, fixes)


def test_distances_in_small_parts(spark, monkeypatch):
    from larder.operators import follow

    monkeypatch.setattr(follow, "DISTANCES", 64)
    lines, fixes = cases(7, hot=80)
    mine = [f for f in fixes if f[0] == "t0" and f[1] == "wind" and None not in f]
    mine.sort(key=lambda f: f[2:])
    line = lines["wind"]
    routes = follow.Routes([np.array([p[1] for p in line])], [np.array([p[0] for p in line])])
    lat, lng = np.array([f[3] for f in mine]), np.array([f[4] for f in mine])
    at, _, _ = follow.segments_along(routes, np.zeros(len(lat), dtype=np.int64), lat, lng, np.arange(len(lat)) == 0, np.zeros(len(lat), dtype=np.int64))
    assert at.tolist() == [r[0] for r in followed(line, 1.0, [f[2:] for f in mine])]
    table = follow.transitions(routes, 0, lat, lng, np.arange(len(line) - 1))
    assert table[0] == at[-1]


def test_a_hot_trip_is_many_tasks(spark):
    lines, fixes = cases(8, hot=300)
    df = spark.createDataFrame(fixes, FIXES)
    sizes = [r["count"] for r in tr.in_slices(df, tr.TRIP, F.col("us"), 20).groupBy(*tr.TRIP, "_slice").count().collect()]
    assert max(sizes) < 60


def test_no_fixes_and_no_routes(spark):
    lines, fixes = cases()
    assert run(spark, lines, []) == []
    assert {r[5:] for r in run(spark, {"other": []}, fixes[:5], target_rows=2)} == {(None,) * 5}
