"""Following fixes along routes, in numpy, for many trips at once: the part of ``trips.match_fixes`` that runs inside tasks.

A fix depends on the fix before it only by the segment that one was matched to, the run of distant fixes up to it and
the time of the last reroute. Segments are guessed for a whole batch, and fixes whose guess was wrong are matched
again until none is: for fixes on a route one or two rounds do, whatever the number of trips.
"""

from __future__ import annotations

import numpy as np

from larder import fixed

NO_SEGMENT = np.iinfo(np.int64).max
#: Distances of a fix to a segment held at once.
DISTANCES = 1 << 20
RUN = fixed.OFF_ROUTE_FIXES - 1


def metres(lat1, lng1, lat2, lng2):
    half_lat, half_lng = np.radians(lat2 - lat1) / 2, np.radians(lng2 - lng1) / 2
    h = np.sin(half_lat) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lng) ** 2
    return 2 * fixed.EARTH_RADIUS_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def _ranges(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each range's first element, number inside its range of every element)."""
    ends = np.cumsum(sizes)
    return ends - sizes, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class Routes:
    """Routes laid end to end: ``first`` vertex and number of ``segments`` of each, metres to the end from every vertex."""

    def __init__(self, lat: list[np.ndarray], lng: list[np.ndarray]):
        sizes = np.array([len(x) for x in lat], dtype=np.int64)
        self.lat, self.lng = np.concatenate(lat), np.concatenate(lng)
        self.first, self.vertices, self.segments = np.cumsum(sizes) - sizes, sizes, np.maximum(sizes - 1, 0)
        legs = metres(self.lat[:-1], self.lng[:-1], self.lat[1:], self.lng[1:])
        self.tail = np.zeros(len(self.lat))
        for at, n in zip(self.first, self.segments, strict=True):
            self.tail[at : at + n] = np.cumsum(legs[at : at + n][::-1])[::-1]

    def project(self, vertex, lat, lng):
        """Metres from a point to the segment that starts at a vertex, and the nearest point on it."""
        ay, ax, by, bx = self.lat[vertex], self.lng[vertex], self.lat[vertex + 1], self.lng[vertex + 1]
        squeeze = np.cos(np.radians(lat))
        dx, dy = (bx - ax) * squeeze, by - ay
        square = dx * dx + dy * dy
        along = ((lng - ax) * squeeze * dx + (lat - ay) * dy) / np.where(square == 0, 1.0, square)
        t = np.where(square == 0, 0.0, np.clip(along, 0.0, 1.0))
        py, px = ay + (by - ay) * t, ax + (bx - ax) * t
        return metres(lat, lng, py, px), py, px


class Distances:
    """Metres from each fix to each segment of its route."""

    def __init__(self, routes: Routes, route: np.ndarray, lat: np.ndarray, lng: np.ndarray):
        self.sizes = routes.segments[route]
        self.bounds, inside = _ranges(self.sizes)
        self.off = routes.project(np.repeat(routes.first[route], self.sizes) + inside, np.repeat(lat, self.sizes), np.repeat(lng, self.sizes))[0]

    def _unbeaten(self, fixes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """From ``start`` on, the first segment that no later one beats by the tie's metres."""
        at, live = start.copy(), np.arange(len(fixes))
        while len(live):
            low, sizes = self.bounds[fixes[live]], self.sizes[fixes[live]]
            heads, inside = _ranges(sizes)
            nearer = np.repeat(self.off[low + at[live]] - fixed.SEGMENT_TIE_M, sizes)
            better = (inside > np.repeat(at[live], sizes)) & (self.off[np.repeat(low, sizes) + inside] < nearer)
            to = np.minimum.reduceat(np.where(better, inside, NO_SEGMENT), heads)
            live, to = live[to < NO_SEGMENT], to[to < NO_SEGMENT]
            at[live] = to
        return at

    def _match(self, fixes: np.ndarray, start: np.ndarray) -> np.ndarray:
        """A fix that is off the rest of its route may be matched to what lies behind it."""
        at = self._unbeaten(fixes, start)
        lost = np.flatnonzero((start > 0) & (self.off[self.bounds[fixes] + at] > fixed.OFF_ROUTE_M))
        low = self.bounds[fixes[lost]]
        anywhere = self._unbeaten(fixes[lost], np.zeros(len(lost), dtype=np.int64))
        back = self.off[low + anywhere] < self.off[low + at[lost]]
        at[lost[back]] = anywhere[back]
        return at

    def follow(self, fixes: np.ndarray, opens: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Segments along paths of fixes; a path begins where ``opens`` is true, at the segment ``entry``."""
        start = entry.copy()
        at = self._match(fixes, start)
        while True:
            due = np.where(opens, entry, np.append(0, at[:-1]))
            wrong = np.flatnonzero(due != start)
            if not len(wrong):
                return at
            start[wrong] = due[wrong]
            at[wrong] = self._match(fixes[wrong], start[wrong])


def segments_along(routes: Routes, route, lat, lng, opens, entry) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, metres off, metres left) of fixes in order; routes without a segment are a straight line to their end."""
    at, off, left = np.zeros(len(route), dtype=np.int64), np.zeros(len(route)), np.zeros(len(route))
    bare = routes.segments[route] == 0
    ended = np.flatnonzero(bare & (routes.vertices[route] > 0))
    end = routes.first[route[ended]]
    off[ended] = left[ended] = metres(lat[ended], lng[ended], routes.lat[end], routes.lng[end])
    rows = np.flatnonzero(~bare)
    chunk = (np.cumsum(routes.segments[route[rows]]) - 1) // DISTANCES
    before = 0
    for part in np.split(rows, np.flatnonzero(np.diff(chunk)) + 1) if len(rows) else []:
        known = Distances(routes, route[part], lat[part], lng[part])
        first, begin = opens[part].copy(), entry[part].copy()
        if not first[0]:  # the chunk before ended inside this path
            carried = route[part] == route[part[0]]
            first[0], begin[carried] = True, before
        at[part] = known.follow(np.arange(len(part)), first, begin)
        before = at[part[-1]]
    vertex = routes.first[route[rows]] + at[rows]
    off[rows], py, px = routes.project(vertex, lat[rows], lng[rows])
    left[rows] = metres(py, px, routes.lat[vertex + 1], routes.lng[vertex + 1]) + routes.tail[vertex + 1]
    return at, off, left


def transitions(routes: Routes, route: int, lat: np.ndarray, lng: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``table`` (segment at the end, for each segment to begin with) carried over more fixes of one path.

    Paths that meet stay together, so few are left after the first fixes; blocks of fixes double from one on.
    """
    n = int(routes.segments[route])
    if n == 0:
        return table
    done, size, room = 0, 1, max(1, DISTANCES // n)
    while done < len(lat):
        block = slice(done, done + size)
        k = len(lat[block])
        known = Distances(routes, np.full(k, route), lat[block], lng[block])
        begins, ends = np.unique(table), []
        for part in np.array_split(begins, -(-len(begins) * k // room)):
            fixes = np.tile(np.arange(k), len(part))
            ends.append(known.follow(fixes, fixes == 0, np.repeat(part, k))[k - 1 :: k])
        table = np.concatenate(ends)[np.searchsorted(begins, table)]
        done, size = done + k, min(size * 2, room)
    return table


def distant_runs(far: np.ndarray, opens: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Number of distant fixes in a row up to each fix; ``run`` of them came before a path's first fix."""
    path, place = np.cumsum(opens), np.arange(len(far))
    near = np.where(far, np.where(opens, place - 1 - run, -1 - RUN), place)
    apart = path * (len(far) + RUN + 2)
    return place - (np.maximum.accumulate(near + apart) - apart)


def reroutes(candidates: list[int], us: list[int], since: int | None, last: int) -> list[int]:
    """Places among one path's ``candidates`` (fixes that end a run of distant ones) where a new route is asked for."""
    found = []
    for c in candidates:
        if c - last > RUN and (since is None or us[c] - since >= fixed.REROUTE_PAUSE_MS * 1000):
            found.append(c)
            since, last = us[c], c
    return found


class RerouteMap:
    """What a slice of a trip does to (run of distant fixes, time of the last reroute), for any such state before it.

    After the first reroute in the slice all that follows is settled. Which fix that is depends on the run before and
    on the time until which a pause lasts, and a pause begun before the slice ends within its first pause of time.
    """

    def __init__(self):
        self.tails: list[int] | None = list(range(RUN + 1))
        self.starts: list[tuple[int, int]] = []  # (run before, time of the first reroute)
        self.states: list[tuple[int, int]] = []  # (run, time of the last reroute) after each start
        self.closed = [False] * (RUN + 1)
        self.begun: int | None = None

    def add(self, far: np.ndarray, us: np.ndarray) -> None:
        if not len(far):
            return
        self.begun = int(us[0]) if self.begun is None else self.begun
        opens, times = np.arange(len(far)) == 0, us.tolist()
        runs = [distant_runs(far, opens, np.full(len(far), run)) for run in range(RUN + 1)]
        candidates = [np.flatnonzero(r > RUN).tolist() for r in runs]
        after: dict[tuple[int, int], tuple[int, int]] = {}
        for state in set(self.states):
            after[state] = self._end(candidates[state[0]], runs[state[0]], times, state[1], -len(far) - RUN)
        self.states = [after[state] for state in self.states]
        for run, tail in enumerate(self.tails):
            if not self.closed[run]:
                for c in candidates[tail]:
                    self.starts.append((run, times[c]))
                    self.states.append(self._end([x for x in candidates[tail] if x > c], runs[tail], times, times[c], c))
                    if times[c] - self.begun >= fixed.REROUTE_PAUSE_MS * 1000:
                        self.closed[run] = True
                        break
        self.tails = [min(RUN, int(runs[tail][-1])) for tail in self.tails]

    @staticmethod
    def _end(candidates, runs, times, since, last) -> tuple[int, int]:
        last = (reroutes(candidates, times, since, last) or [last])[-1]
        return min(RUN, int(runs[-1]), len(times) - 1 - last), times[last] if last >= 0 else since


def after_slice(starts: list[dict], tails: list[int], run: int, since: int | None) -> tuple[int, int | None]:
    """The state behind a slice, given the one before it and the slice's map."""
    for start in starts:
        if start["run"] == run and (since is None or start["us"] - since >= fixed.REROUTE_PAUSE_MS * 1000):
            return start["last_run"], start["last_us"]
    return tails[run], since
