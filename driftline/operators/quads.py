"""Footprints of a cell against positions, in numpy on Arrow tables.

In one tangent plane about the cell, footprints stay quads with straight edges.
Positions are sorted by strips of that plane, and within a strip by x: what a
footprint certainly holds of a strip is one run of positions, so counts, minima and
maxima are kept per run. Only positions next to its border are tested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The four corners of a footprint as columns.
CORNERS = [f"_{axis}{k}" for k in range(4) for axis in ("ra", "dec")]
# Runs or pairs judged at once, footprints that are compared with all
# positions, and how far a plane reaches from its centre (cosine).
_ROWS, _FEW, _PLANE_COS = 1_000_000, 64, 0.5
# Runs of a footprint per square root of the positions inside; a run costs some ten tests.
_STRIPS = 0.7


def vectors(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    ra, dec = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=-1)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy().astype(float)


def _basis(centres: np.ndarray) -> np.ndarray:
    """East, north and outward directions (…, 3, 3) at unit vectors."""
    x, y, z = np.moveaxis(centres, -1, 0)
    flat = np.hypot(x, y)
    polar = flat < 1e-300
    ex = np.where(polar, 0.0, -y / np.where(polar, 1.0, flat))
    ey = np.where(polar, 1.0, x / np.where(polar, 1.0, flat))
    east = np.stack([ex, ey, np.zeros_like(ex)], axis=-1)
    return np.stack([east, np.cross(centres, east), centres], axis=-2)


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def around_centre(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Order of the corners (n, 4) by angle about their mean."""
    return np.lexsort((y, x, np.arctan2(y - y.mean(axis=1)[:, None], x - x.mean(axis=1)[:, None])))


def _turns(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cross products of successive edges."""
    dx, dy = np.roll(x, -1, axis=1) - x, np.roll(y, -1, axis=1) - y
    return dx * np.roll(dy, -1, axis=1) - dy * np.roll(dx, -1, axis=1)


def footprints(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners as unit vectors (n, 4, 3) in order about their centre, the centres,
    and which footprints are convex beyond doubt."""
    flat = np.stack([column(table, c) for c in CORNERS], axis=1)
    corners = vectors(flat[:, 0::2], flat[:, 1::2])
    centre = _unit(corners.sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        plane = np.einsum("nkc,nbc->nkb", corners, _basis(centre))
        x, y = plane[:, :, 0] / plane[:, :, 2], plane[:, :, 1] / plane[:, :, 2]
    order = around_centre(x, y)
    x, y = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    size = np.square(x).max(axis=1) + np.square(y).max(axis=1)
    with np.errstate(invalid="ignore"):
        convex = (_turns(x, y).min(axis=1) > 1e-9 * size) & (plane[:, :, 2].min(axis=1) > 0.0)
    return np.take_along_axis(corners, order[:, :, None], 1), centre, convex


def ranges(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the range, each of its values), in blocks."""
    size = np.maximum(stop - start, 0)
    some = np.flatnonzero(size)
    ends = np.cumsum(size[some])
    at = 0
    while at < len(some):
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + _ROWS, side="right")))
        own = some[at:upto]
        offset = np.arange(ends[upto - 1] - base) - np.repeat(ends[at:upto] - size[own] - base, size[own])
        number = np.repeat(own, size[own])
        yield number, start[number] + offset
        at = upto


@dataclass
class Tally:
    """Footprints that hold each position: number, first and last time, depth."""

    count: np.ndarray
    first: np.ndarray
    last: np.ndarray
    deepest: np.ndarray

    @classmethod
    def empty(cls, n: int) -> Tally:
        return cls(np.zeros(n, np.int64), np.full(n, np.inf), np.full(n, -np.inf), np.full(n, -np.inf))

    def add(self, at, time: np.ndarray, depth: np.ndarray) -> None:
        """Without the count; ``at`` may repeat."""
        np.minimum.at(self.first, at, time)
        np.maximum.at(self.last, at, time)
        np.maximum.at(self.deepest, at, depth)

    def merge(self, rows: np.ndarray, other: Tally) -> None:
        """``other`` tells of the positions ``rows``, each once."""
        self.count[rows] += other.count
        self.first[rows] = np.minimum(self.first[rows], other.first)
        self.last[rows] = np.maximum(self.last[rows], other.last)
        self.deepest[rows] = np.maximum(self.deepest[rows], other.deepest)


@dataclass
class _Quads:
    x: np.ndarray
    y: np.ndarray
    convex: np.ndarray
    time: np.ndarray
    depth: np.ndarray

    def take(self, rows) -> _Quads:
        return _Quads(self.x[rows], self.y[rows], self.convex[rows], self.time[rows], self.depth[rows])

    def __len__(self) -> int:
        return len(self.time)

    def hold(self, quad, px: np.ndarray, py: np.ndarray) -> np.ndarray:
        """Even-odd test of points against the quads numbered ``quad`` (broadcast)."""
        odd = np.zeros(np.broadcast_shapes(np.shape(quad), px.shape), bool)
        for k in range(4):
            x1, y1, x2, y2 = (v[quad, c] for c in (k, (k + 1) % 4) for v in (self.x, self.y))
            with np.errstate(divide="ignore", invalid="ignore"):
                odd ^= ((y1 > py) != (y2 > py)) & (px < x1 + (py - y1) * (x2 - x1) / (y2 - y1))
        return odd


def _compare_all(quads: _Quads, px, py, start, end) -> Tally:
    """Every footprint with every position, in blocks of positions."""
    tally = Tally.empty(len(px))
    step = max(1, _ROWS // len(quads))
    number = np.arange(len(quads))[None, :]
    for at in range(0, len(px), step):
        rows = slice(at, at + step)
        held = quads.hold(number, px[rows, None], py[rows, None])
        held &= (quads.time >= start[rows, None]) & (quads.time < end[rows, None])
        tally.count[rows] = held.sum(axis=1)
        p, q = np.nonzero(held)
        tally.add(p + at, quads.time[q], quads.depth[q])
    return tally


def _in_strips(quads: _Quads, px, py) -> Tally:
    """Convex footprints, whatever the time."""
    n = len(px)
    low, high = quads.y.min(axis=1), quads.y.max(axis=1)
    x0, y0 = px.min(), py.min()
    wide, tall = max(px.max() - x0, 1e-12), max(py.max() - y0, 1e-12)
    width, height = np.median(quads.x.max(axis=1) - quads.x.min(axis=1)), max(np.median(high - low), 1e-12)
    inside = n * min(1.0, width / wide) * min(1.0, height / tall)
    strips = int(min(max(1.0, tall / height * _STRIPS * math.sqrt(inside)), 4 * n, 1_000_000))
    step = tall / strips
    # What rounding may move: such positions are tested.
    room = 1e-10 * (1.0 + max(np.abs(quads.x).max(), np.abs(quads.y).max(), np.abs(px).max(), np.abs(py).max()))
    # A strip and a place in it as one number.
    unit = 2.0**40 / (wide * (1.0 + 1e-9))

    def place(strip, x):
        return strip * 2**41 + 2**40 + np.floor((np.clip(x, x0 - wide * 1e-3, x0 + wide * 1.001) - x0) * unit).astype(np.int64)

    own = np.clip(((py - y0) / step).astype(np.int64), 0, strips - 1)
    key = place(own, px)
    order = np.argsort(key, kind="stable")
    key, sx, sy = key[order], px[order], py[order]

    levels = max(1, n.bit_length())
    runs, border = Tally.empty(levels * n), Tally.empty(n)
    change = np.zeros(n + 1, np.int64)
    first = np.maximum(np.floor((low - room - y0) / step), 0).astype(np.int64)
    last = np.minimum(np.floor((high + room - y0) / step), strips - 1).astype(np.int64)
    for quad, strip in ranges(first, last + 1):
        bottom, top = y0 + strip * step - room, y0 + (strip + 1) * step + room
        outer = np.full((2, len(quad)), np.inf)
        inner = np.full((2, len(quad)), -np.inf)
        for k in range(4):
            xa, ya, xb, yb = (v[:, c] for c in (k, (k + 1) % 4) for v in (quads.x, quads.y))
            with np.errstate(divide="ignore", invalid="ignore"):
                slope = np.where(ya == yb, 0.0, (xb - xa) / (yb - ya))
            elow, ehigh, even = np.minimum(ya, yb)[quad], np.maximum(ya, yb)[quad], (ya == yb)[quad]
            s, xs, ys = slope[quad], xa[quad], ya[quad]
            met = (elow <= top) & (ehigh >= bottom)
            for y in (bottom, top):
                at = xs + (np.clip(y, elow, ehigh) - ys) * s
                outer[0] = np.minimum(outer[0], np.where(met, at, np.inf))
                outer[1] = np.minimum(outer[1], np.where(met, -at, np.inf))
            # The end of a level edge that is left out above.
            flat = met & even
            if flat.any():
                other = xb[quad]
                outer[0] = np.minimum(outer[0], np.where(flat, other, np.inf))
                outer[1] = np.minimum(outer[1], np.where(flat, -other, np.inf))
            # Edges of a convex quad in order run up on its right side, down on its left one.
            side = np.where((ya < yb)[quad], 1, 0)
            for y in (bottom, top):
                at = xs + (y - ys) * s
                crossed = (elow <= y) & (ehigh >= y) & ~even
                inner[0] = np.where(crossed & (side == 0), np.maximum(inner[0], at), inner[0])
                inner[1] = np.where(crossed & (side == 1), np.maximum(inner[1], -at), inner[1])
        whole = (low[quad] <= bottom) & (high[quad] >= top)
        a = np.searchsorted(key, place(strip, outer[0] - room) - 1, side="left")
        d = np.searchsorted(key, place(strip, room - outer[1]) + 1, side="right")
        b = np.searchsorted(key, place(strip, np.where(whole, inner[0], 0.0) + room) + 1, side="right")
        c = np.searchsorted(key, place(strip, -np.where(whole, inner[1], 0.0) - room) - 1, side="left")
        run = whole & (b < c)
        b, c = np.where(run, np.maximum(b, a), d), np.where(run, np.minimum(c, d), d)
        # Runs: two overlapping halves of a power of two.
        i = np.flatnonzero(run & (b < c))
        change += np.bincount(b[i], minlength=n + 1) - np.bincount(c[i], minlength=n + 1)
        level = np.floor(np.log2(c[i] - b[i])).astype(np.int64)
        time, depth = quads.time[quad[i]], quads.depth[quad[i]]
        runs.add(level * n + b[i], time, depth)
        runs.add(level * n + c[i] - (1 << level), time, depth)
        for start, stop in ((a, b), (c, d)):
            for number, p in ranges(start, stop):
                q = quad[number]
                held = quads.hold(q, sx[p], sy[p])
                q, p = q[held], p[held]
                border.count += np.bincount(p, minlength=n)
                border.add(p, quads.time[q], quads.depth[q])
    for level in range(levels - 1, 0, -1):
        half = 1 << (level - 1)
        for values, pick in ((runs.first, np.minimum), (runs.last, np.maximum), (runs.deepest, np.maximum)):
            below, own = values[(level - 1) * n : level * n], values[level * n : (level + 1) * n]
            pick(below, own, out=below)
            pick(below[half:], own[: max(0, n - half)], out=below[half:])
    border.merge(np.arange(n), Tally(np.cumsum(change[:-1]), runs.first[:n], runs.last[:n], runs.deepest[:n]))
    tally = Tally.empty(n)
    tally.merge(order, border)
    return tally


def _in_time(quads: _Quads, px, py, start, end) -> Tally:
    """Footprints in order of time. Positions whose window holds all of them are
    judged at once, the others with either half of the footprints."""
    tally = Tally.empty(len(px))
    meets = (end > quads.time[0]) & (start <= quads.time[-1])
    if len(quads) <= _FEW or len(quads) * np.count_nonzero(meets) <= _ROWS // 8:
        i = np.flatnonzero(meets)
        if len(i):
            tally.merge(i, _compare_all(quads, px[i], py[i], start[i], end[i]))
        return tally
    whole = (start <= quads.time[0]) & (end > quads.time[-1])
    i = np.flatnonzero(whole)
    if len(i):
        if quads.convex.any():
            tally.merge(i, _in_strips(quads.take(quads.convex), px[i], py[i]))
        if not quads.convex.all():
            tally.merge(i, _compare_all(quads.take(~quads.convex), px[i], py[i], start[i], end[i]))
    i = np.flatnonzero(meets & ~whole)
    if len(i):
        middle = len(quads) // 2
        for half in (slice(0, middle), slice(middle, None)):
            tally.merge(i, _in_time(quads.take(half), px[i], py[i], start[i], end[i]))
    return tally


def coverage(corners, convex, time, depth, positions, start, end) -> Tally:
    """What covers each position (unit vectors) in its window. Footprints:
    ``corners`` (n, 4, 3) in order, ``convex``, times and depths."""
    tally = Tally.empty(len(positions))
    if not len(time) or not len(positions):
        return tally
    centre = _unit(corners.sum(axis=(0, 1)))
    if len(time) > 1 and (corners @ centre).min() < _PLANE_COS:
        middle = len(time) // 2
        for half in (slice(0, middle), slice(middle, None)):
            tally.merge(np.arange(len(positions)), coverage(corners[half], convex[half], time[half], depth[half], positions, start, end))
        return tally
    basis = _basis(centre)
    plane, at = corners @ basis.T, positions @ basis.T
    near = np.flatnonzero(at[:, 2] > min(_PLANE_COS, plane[:, :, 2].min()) * 0.5)
    if len(near):
        x, y = plane[:, :, 0] / plane[:, :, 2], plane[:, :, 1] / plane[:, :, 2]
        order = np.argsort(time, kind="stable")
        quads = _Quads(x, y, convex, time, depth).take(order)
        px, py = (at[near, k] / at[near, 2] for k in (0, 1))
        tally.merge(near, _in_time(quads, px, py, start[near], end[near]))
    return tally


def overlaps_box(x: np.ndarray, y: np.ndarray, half: float) -> np.ndarray:
    """Convex quads (n, 4), corners in order, meet the box |x|, |y| <= half: no axis
    of either one separates them."""
    met = np.ones(len(x), bool)
    for v in (x, y):
        met &= (v.min(axis=1) <= half) & (v.max(axis=1) >= -half)
    for k in range(4):
        dx, dy = (v[:, (k + 1) % 4] - v[:, k] for v in (x, y))
        along = x * dy[:, None] - y * dx[:, None]
        reach = half * (np.abs(dx) + np.abs(dy))
        met &= ~((along.min(axis=1) > reach) | (along.max(axis=1) < -reach))
    return met


def box_hits(exposures: pa.Table, radius_arcsec: np.ndarray, searches: pa.Table, room: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each search (its row) with the rows of the exposures that its box meets in
    its window. ``room``: circles about a box, in half sides."""
    time = column(exposures, "obsjd")
    order = np.argsort(time, kind="stable")
    time, table = time[order], exposures.take(pa.array(order))
    corners, centres, convex = footprints(table)
    angle = np.radians(radius_arcsec[order] / 3600.0)
    cosine, sine = np.cos(angle), np.sin(angle)
    half, start, end = (column(searches, c) for c in ("radius_deg", "start_jd", "end_jd"))
    low, high = np.searchsorted(time, start, side="left"), np.searchsorted(time, end, side="left")
    places = vectors(column(searches, "p_ra"), column(searches, "p_dec"))
    for row in np.flatnonzero(low < high):
        part = slice(low[row], high[row])
        own = np.radians(half[row] * room)
        apart = centres[part] @ places[row]
        near = np.flatnonzero((apart >= cosine[part] * np.cos(own) - sine[part] * np.sin(own)) | (angle[part] + own >= np.pi)) + low[row]
        if not len(near):
            continue
        plane = corners[near] @ _basis(places[row]).T
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (np.degrees(plane[:, :, k] / plane[:, :, 2]) for k in (0, 1))
        sure = convex[near] & (plane[:, :, 2].min(axis=1) > 0.0)
        if not sure.all():
            turn = around_centre(x, y)
            x, y = (np.where(sure[:, None], v, np.take_along_axis(v, turn, 1)) for v in (x, y))
        yield row, order[near[overlaps_box(x, y, half[row])]]
