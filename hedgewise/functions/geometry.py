"""Vectorised geometry functions over WKB columns, coordinates in metres.

Areas are integrated over vertical slabs between all vertices and crossings: inside a
slab the even-odd overlap height is linear in x, so its value at the middle times the
width is exact. Holes, concave outlines and several parts need no special case.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLYGON, MULTIPOLYGON, LINESTRING, MULTILINESTRING, POINT = (
    "POLYGON", "MULTIPOLYGON", "LINESTRING", "MULTILINESTRING", "POINT",
)
# WKB type numbers.
WKB_KINDS = {1: POINT, 2: LINESTRING, 3: POLYGON, 4: "MULTIPOINT", 5: MULTILINESTRING, 6: MULTIPOLYGON}
CELL_LIMIT = 2_000_000
ON_EDGE = 1e-9

FACTS_TYPE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("status", "kind")]
    + [T.StructField(n, T.DoubleType()) for n in ("area", "length", "minx", "miny", "maxx", "maxy")]
    + [T.StructField("is_box", T.BooleanType())]
)

_POINT_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in "xy"])
RINGS_TYPE = T.ArrayType(
    T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ring", T.IntegerType()), T.StructField("points", T.ArrayType(_POINT_TYPE))])
)


# -- decoding --------------------------------------------------------------------


def _decode(data: bytes, at: int = 0, blocks: list | None = None):
    """(kind, coordinate arrays per ring or line, grouped by part) and the end offset.

    ``blocks`` gets (start, count, numbers per point, byte order) of each array; the bytes outside them are the layout.
    """
    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    dims = 2
    if code & 0xE0000000:
        dims += bool(code & 0x80000000) + bool(code & 0x40000000)
        at += 4 if code & 0x20000000 else 0
        code &= 0xFF
    elif code >= 1000:
        dims += 2 if code >= 3000 else 1
        code %= 1000
    kind = WKB_KINDS[code]

    def points(count: int, at: int):
        size = 8 * dims * count
        if at + size > len(data):
            raise ValueError("truncated")
        if blocks is not None:
            blocks.append((at, count, dims, order))
        block = np.frombuffer(data, order + "f8", dims * count, at).reshape(count, dims)
        return block[:, :2].astype(float), at + size

    def number(at: int):
        return struct.unpack_from(order + "I", data, at)[0], at + 4

    if kind == POINT:
        xy, at = points(1, at)
        return kind, [[xy]], at
    if kind == LINESTRING:
        count, at = number(at)
        xy, at = points(count, at)
        return kind, [[xy]], at
    parts = []
    count, at = number(at)
    if kind == POLYGON:
        rings = []
        for _ in range(count):
            size, at = number(at)
            xy, at = points(size, at)
            rings.append(xy)
        return kind, [rings] if rings else [], at
    for _ in range(count):
        _, inner, at = _decode(data, at, blocks)
        parts.extend(inner)
    return kind, parts, at


def _parts(data):
    return _decode(bytes(data))[:2]


class Alike:
    """Shapes of a batch with the same kind and numbers of parts, rings and points: ``rows``, and per ring an array of all
    their points. Rings are numbered by ``part`` and ``ring``."""

    def __init__(self, rows: np.ndarray, kind: str, counts: list[int], xys: list[np.ndarray]):
        self.rows, self.kind, self.xys = rows, kind, xys
        self.part = np.repeat(np.arange(len(counts)), counts)
        self.ring = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, int)

    def points(self) -> np.ndarray:
        return np.concatenate(self.xys, axis=1) if self.xys else np.empty((len(self.rows), 0, 2))

    def edges(self) -> np.ndarray:
        """Edges (x1, y1, x2, y2) of all rings or lines, shape by shape."""
        rows = [np.concatenate([xy[:, :-1], xy[:, 1:]], axis=2) for xy in self.xys if xy.shape[1] > 1]
        return np.concatenate(rows, axis=1) if rows else np.empty((len(self.rows), 0, 4))

    def of(self, chosen: np.ndarray) -> Alike:
        made = object.__new__(Alike)
        made.rows, made.kind, made.part, made.ring = self.rows[chosen], self.kind, self.part, self.ring
        made.xys = [xy[chosen] for xy in self.xys]
        return made


def _bytes(wkb: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a batch, the bounds of its values, and which values are not null."""
    wkb = wkb.cast(pa.large_binary())
    _, bounds, data = wkb.buffers()
    if not len(wkb) or bounds is None:
        return np.zeros(0, np.uint8), np.zeros(len(wkb) + 1, np.int64), np.zeros(len(wkb), bool)
    at = np.frombuffer(bounds, np.int64)[wkb.offset : wkb.offset + len(wkb) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, at, wkb.is_valid().to_numpy(zero_copy_only=False)


def _alike(wkb: pa.Array) -> Iterator[Alike]:
    """The readable shapes of a batch by layout: shapes that differ in coordinates only are decoded as one array."""
    data, at, valid = _bytes(wkb)
    sizes = np.where(valid, np.diff(at), -1)
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= 0]
    for rows in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if not len(rows) or not sizes[rows[0]]:
            continue
        size = int(sizes[rows[0]])
        block = np.lib.stride_tricks.sliding_window_view(data, size)[at[rows]]
        while len(rows):
            found: list = []
            try:
                kind, parts, _ = _decode(block[0].tobytes(), 0, found)
            except (ValueError, KeyError, IndexError, struct.error):
                rows, block = rows[1:], block[1:]
                continue
            layout = np.ones(size, bool)
            for start, count, dims, _ in found:
                layout[start : start + 8 * dims * count] = False
            same = (block[:, layout] == block[0, layout]).all(1)
            own = block[same]
            xys = [
                np.ascontiguousarray(own[:, start : start + 8 * dims * count]).view(order_ + "f8")
                .reshape(len(own), count, dims)[:, :, :2].astype(float)
                for start, count, dims, order_ in found
            ]
            yield Alike(rows[same], kind, [len(rings) for rings in parts], xys)
            rows, block = rows[~same], block[~same]


def _edges(parts) -> np.ndarray:
    """Edges (x1, y1, x2, y2) of all rings or lines."""
    rows = [np.hstack([xy[:-1], xy[1:]]) for rings in parts for xy in rings if len(xy) > 1]
    return np.vstack(rows) if rows else np.empty((0, 4))


def _is_box(parts) -> bool:
    if len(parts) != 1 or len(parts[0]) != 1 or len(parts[0][0]) != 5:
        return False
    steps = np.diff(parts[0][0], axis=0)
    straight = (steps == 0).sum(axis=1) == 1
    turns = (steps[:-1] != 0)[:, 0] != (steps[1:] != 0)[:, 0]
    return bool(straight.all() and turns.all() and (parts[0][0][0] == parts[0][0][4]).all())


# -- measures ----------------------------------------------------------------------


def _ring_area(xy: np.ndarray) -> float:
    d = xy - xy[0]
    return float(0.5 * (d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum())


def _area(parts) -> float:
    return sum(abs(_ring_area(r[0])) - sum(abs(_ring_area(h)) for h in r[1:]) for r in parts)


def _length(edges: np.ndarray) -> float:
    return float(np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]).sum())


def _crossing_xs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of every crossing of an edge of ``a`` with an edge of ``b``."""
    found = []
    step = max(1, CELL_LIMIT // max(1, len(b)))
    dbx, dby = b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]
    for start in range(0, len(a), step):
        part = a[start:start + step]
        dax, day = (part[:, 2] - part[:, 0])[:, None], (part[:, 3] - part[:, 1])[:, None]
        ox, oy = b[:, 0] - part[:, 0][:, None], b[:, 1] - part[:, 1][:, None]
        cross = dax * dby - day * dbx
        with np.errstate(divide="ignore", invalid="ignore"):
            s, u = (ox * dby - oy * dbx) / cross, (ox * day - oy * dax) / cross
            hit = (cross != 0) & (s >= 0) & (s <= 1) & (u >= 0) & (u <= 1)
            found.append((part[:, 0][:, None] + s * dax)[hit])
    return np.concatenate(found) if found else np.empty(0)


def _heights(edges: np.ndarray, x: np.ndarray) -> np.ndarray:
    """y of each edge at each x, infinite where the edge does not pass it."""
    low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    passes = (low < x[:, None]) & (x[:, None] < high)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = (edges[:, 3] - edges[:, 1]) / (edges[:, 2] - edges[:, 0])
        y = edges[:, 1] + (x[:, None] - edges[:, 0]) * slope
    return np.where(passes, y, np.inf)


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area common to two even-odd regions given by their edges."""
    if not len(a) or not len(b):
        return 0.0
    origin = np.tile(a[0, :2], 2)
    a, b = a - origin, b - origin
    left = max(a[:, [0, 2]].min(), b[:, [0, 2]].min())
    right = min(a[:, [0, 2]].max(), b[:, [0, 2]].max())
    if left >= right:
        return 0.0
    xs = np.concatenate(
        [a[:, 0], a[:, 2], b[:, 0], b[:, 2], _crossing_xs(a, b), _crossing_xs(a, a), _crossing_xs(b, b)]
    )
    xs = np.unique(np.concatenate([xs[(xs > left) & (xs < right)], [left, right]]))
    widths, middles = np.diff(xs), (xs[:-1] + xs[1:]) / 2
    from_a = np.concatenate([np.ones(len(a), int), np.zeros(len(b), int)])
    total = 0.0
    step = max(1, CELL_LIMIT // len(from_a))
    for start in range(0, len(middles), step):
        x = middles[start:start + step]
        y = np.hstack([_heights(a, x), _heights(b, x)])
        order = np.argsort(y, axis=1)
        y = np.take_along_axis(y, order, 1)
        inside = (np.cumsum(from_a[order], 1) % 2 == 1) & (np.cumsum(1 - from_a[order], 1) % 2 == 1)
        top = np.where(np.isfinite(y[:, 1:]), y[:, 1:], 0.0)
        base = np.where(np.isfinite(y[:, :-1]), y[:, :-1], 0.0)
        both = inside[:, :-1] & np.isfinite(y[:, 1:])
        total += float(((top - base) * both).sum(1) @ widths[start:start + step])
    return total


def _inside(edges: np.ndarray, xy: np.ndarray) -> np.ndarray:
    """Whether points are inside the even-odd region or on its edge."""
    y1, y2 = edges[:, 1], edges[:, 3]
    above = (y1 > xy[:, 1][:, None]) != (y2 > xy[:, 1][:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = edges[:, 0] + (xy[:, 1][:, None] - y1) * (edges[:, 2] - edges[:, 0]) / (y2 - y1)
    odd = (above & (xy[:, 0][:, None] < at)).sum(1) % 2 == 1
    return odd | (_distances(edges, xy) <= ON_EDGE)


def _distances(edges: np.ndarray, xy: np.ndarray) -> np.ndarray:
    dx, dy = edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1]
    size = np.where(dx * dx + dy * dy == 0, 1.0, dx * dx + dy * dy)
    px, py = xy[:, 0][:, None] - edges[:, 0], xy[:, 1][:, None] - edges[:, 1]
    s = np.clip((px * dx + py * dy) / size, 0, 1)
    return np.hypot(px - s * dx, py - s * dy).min(1)


def _length_outside(line: np.ndarray, region: np.ndarray) -> float:
    """Length of line edges outside a region; running along its edge counts as inside."""
    total = 0.0
    for x1, y1, x2, y2 in line:
        size = float(np.hypot(x2 - x1, y2 - y1))
        if size == 0:
            continue
        dx, dy = x2 - x1, y2 - y1
        ex, ey = region[:, 2] - region[:, 0], region[:, 3] - region[:, 1]
        cross = dx * ey - dy * ex
        ox, oy = region[:, 0] - x1, region[:, 1] - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            s, u = (ox * ey - oy * ex) / cross, (ox * dy - oy * dx) / cross
        hit = s[(cross != 0) & (s > 0) & (s < 1) & (u >= 0) & (u <= 1)]
        along = (cross == 0) & (np.abs(ox * dy - oy * dx) <= ON_EDGE * size)
        ends = np.concatenate([(ox * dx + oy * dy)[along], ((ox + ex) * dx + (oy + ey) * dy)[along]]) / size**2
        cuts = np.unique(np.concatenate([[0.0, 1.0], hit, ends[(ends > 0) & (ends < 1)]]))
        mids = (cuts[:-1] + cuts[1:]) / 2
        out = ~_inside(region, np.column_stack([x1 + mids * dx, y1 + mids * dy]))
        total += float(np.diff(cuts)[out].sum() * size)
    return total


# -- measures of many pairs of shapes with the same numbers of edges -------------------------


def _crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x of the crossing of each edge of ``a`` with each edge of ``b``, NaN where they do not cross."""
    p, q = a[:, :, None], b[:, None]
    dax, day = p[..., 2] - p[..., 0], p[..., 3] - p[..., 1]
    dbx, dby = q[..., 2] - q[..., 0], q[..., 3] - q[..., 1]
    ox, oy = q[..., 0] - p[..., 0], q[..., 1] - p[..., 1]
    cross = dax * dby - day * dbx
    with np.errstate(divide="ignore", invalid="ignore"):
        s, u = (ox * dby - oy * dbx) / cross, (ox * day - oy * dax) / cross
        hit = (cross != 0) & (s >= 0) & (s <= 1) & (u >= 0) & (u <= 1)
        return np.where(hit, p[..., 0] + s * dax, np.nan).reshape(len(a), -1)


def _overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_overlap`` of each pair."""
    origin = np.tile(a[:, :1, :2], 2)
    a, b = a - origin, b - origin
    left = np.maximum(a[:, :, [0, 2]].min((1, 2)), b[:, :, [0, 2]].min((1, 2)))[:, None]
    right = np.minimum(a[:, :, [0, 2]].max((1, 2)), b[:, :, [0, 2]].max((1, 2)))[:, None]
    xs = [a[:, :, 0], a[:, :, 2], b[:, :, 0], b[:, :, 2], _crossings(a, b), _crossings(a, a), _crossings(b, b)]
    xs = np.concatenate(xs, axis=1)
    # what lies beside the common range, or is no crossing, makes a slab without width
    xs = np.sort(np.concatenate([np.where((xs > left) & (xs < right), xs, left), left, right], axis=1), axis=1)
    kept = (np.diff(xs, axis=1) > 0).any(0)
    widths, x = np.diff(xs, axis=1)[:, kept], ((xs[:, :-1] + xs[:, 1:]) / 2)[:, kept, None]
    edges = np.concatenate([a, b], axis=1)[:, None]
    from_a = np.repeat([1, 0], [a.shape[1], b.shape[1]])
    low, high = np.minimum(edges[..., 0], edges[..., 2]), np.maximum(edges[..., 0], edges[..., 2])
    with np.errstate(divide="ignore", invalid="ignore"):
        y = edges[..., 1] + (x - edges[..., 0]) * ((edges[..., 3] - edges[..., 1]) / (edges[..., 2] - edges[..., 0]))
    y = np.where((low < x) & (x < high), y, np.inf)
    order = np.argsort(y, axis=2)
    y = np.take_along_axis(y, order, 2)
    inside = (np.cumsum(from_a[order], 2) % 2 == 1) & (np.cumsum(1 - from_a[order], 2) % 2 == 1)
    top = np.where(np.isfinite(y[..., 1:]), y[..., 1:], 0.0)
    base = np.where(np.isfinite(y[..., :-1]), y[..., :-1], 0.0)
    both = inside[..., :-1] & np.isfinite(y[..., 1:])
    return np.where(left < right, (((top - base) * both).sum(2) * widths).sum(1, keepdims=True), 0.0)[:, 0]


def _insides(edges: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether points are inside each region or on its edge, and their distance from its edges."""
    e, px, py = edges[:, None], xy[..., 0, None], xy[..., 1, None]
    above = (e[..., 1] > py) != (e[..., 3] > py)
    dx, dy = e[..., 2] - e[..., 0], e[..., 3] - e[..., 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        at = e[..., 0] + (py - e[..., 1]) * dx / dy
    odd = (above & (px < at)).sum(2) % 2 == 1
    size = np.where(dx * dx + dy * dy == 0, 1.0, dx * dx + dy * dy)
    px, py = px - e[..., 0], py - e[..., 1]
    s = np.clip((px * dx + py * dy) / size, 0, 1)
    away = np.hypot(px - s * dx, py - s * dy).min(2)
    return odd | (away <= ON_EDGE), away


def _lengths_outside(line: np.ndarray, region: np.ndarray) -> np.ndarray:
    """``_length_outside`` of each pair."""
    total = np.zeros(len(line))
    for k in range(line.shape[1]):
        x1, y1 = line[:, k, 0, None], line[:, k, 1, None]
        dx, dy = line[:, k, 2, None] - x1, line[:, k, 3, None] - y1
        size = np.hypot(dx, dy)
        ex, ey = region[..., 2] - region[..., 0], region[..., 3] - region[..., 1]
        cross = dx * ey - dy * ex
        ox, oy = region[..., 0] - x1, region[..., 1] - y1
        with np.errstate(divide="ignore", invalid="ignore"):
            s, u = (ox * ey - oy * ex) / cross, (ox * dy - oy * dx) / cross
            hit = np.where((cross != 0) & (u >= 0) & (u <= 1), s, 0.0)
            along = (cross == 0) & (np.abs(ox * dy - oy * dx) <= ON_EDGE * size)
            ends = np.concatenate([ox * dx + oy * dy, (ox + ex) * dx + (oy + ey) * dy], axis=1) / size**2
        ends = np.where(np.tile(along, 2), ends, 0.0)
        cuts = np.concatenate([hit, ends], axis=1)
        cuts = np.where((cuts > 0) & (cuts < 1), cuts, 0.0)
        cuts = np.sort(np.concatenate([cuts, np.ones_like(x1), np.zeros_like(x1)], axis=1), axis=1)
        mids = (cuts[:, :-1] + cuts[:, 1:]) / 2
        within, _ = _insides(region, np.stack([x1 + mids * dx, y1 + mids * dy], axis=2))
        total += np.where(size[:, 0] > 0, (np.diff(cuts, axis=1) * ~within).sum(1) * size[:, 0], 0.0)
    return total


# -- shapes and groups of few edges, a batch at a time ---------------------------------------

#: Edges of a shape or group up to which a batch of them is compared edge by edge within its rows.
ROW_EDGES = 64

LOOK_TYPE = T.StructType(
    [T.StructField("crossings", T.ArrayType(T.StructType(
        [T.StructField(n, T.IntegerType()) for n in ("part", "step", "ring", "i", "j")] + [T.StructField(n, T.DoubleType()) for n in "xy"]
    ))), T.StructField("apart", T.BooleanType())]
)

SWEPT_TYPE = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("only_a", "both", "twice")]
    + [T.StructField("twice_at", T.StructType([T.StructField(n, T.DoubleType()) for n in "yx"]))]
)


def _turns(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Twice the signed area of the triangle of each edge and a place."""
    return (edges[..., 2] - edges[..., 0]) * (y - edges[..., 1]) - (edges[..., 3] - edges[..., 1]) * (x - edges[..., 0])


def _row_crossings(shapes: Alike) -> tuple[np.ndarray, ...]:
    """Edges of one ring that touch without being neighbours, and edges of a hole that cross another ring of their part:
    place of the shape, part, step, ring, i, j, x, y. No ring may hold a point twice in turn."""
    sizes = np.array([xy.shape[1] - 1 for xy in shapes.xys])
    nth = np.repeat(np.arange(len(sizes)), sizes)
    part, ring, i, n = shapes.part[nth], shapes.ring[nth], np.concatenate([np.arange(k) for k in sizes]), sizes[nth]
    a, b = np.triu_indices(len(nth), 1)
    neighbours = (b == a + 1) | ((i[a] == 0) & (i[b] == n[a] - 1))
    kept = (part[a] == part[b]) & ((ring[a] != ring[b]) | ~neighbours)
    a, b = a[kept], b[kept]
    if not len(a):
        return (np.zeros(0, int),) * 6 + (np.zeros(0),) * 2
    edges = shapes.edges()
    p, q = edges[:, a], edges[:, b]
    near = np.ones(p.shape[:2], bool)
    for c in (0, 1):
        near &= np.minimum(p[..., c], p[..., c + 2]) <= np.maximum(q[..., c], q[..., c + 2])
        near &= np.minimum(q[..., c], q[..., c + 2]) <= np.maximum(p[..., c], p[..., c + 2])
    shape, k = np.nonzero(near)
    p, q, a, b = p[shape, k], q[shape, k], a[k], b[k]
    s1, s2, s3, s4 = _turns(p, q[:, 0], q[:, 1]), _turns(p, q[:, 2], q[:, 3]), _turns(q, p[:, 0], p[:, 1]), _turns(q, p[:, 2], p[:, 3])
    same = ring[a] == ring[b]
    hit = np.where(same, (s1 * s2 <= 0) & (s3 * s4 <= 0), (s1 * s2 < 0) & (s3 * s4 < 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        at = [np.where(s3 == s4, q[:, c], p[:, c] + s3 / (s3 - s4) * (p[:, c + 2] - p[:, c])) for c in (0, 1)]
    found = (shape, part[a], np.where(same, 0, 1), ring[b], i[a], i[b], *at)
    return tuple(f[hit] for f in found)


def _parts_apart(shapes: Alike) -> np.ndarray:
    """Shapes of which an edge of one part separates it from another, for all parts: they share no ground."""
    parts = [[xy for xy, p in zip(shapes.xys, shapes.part) if p == part] for part in np.unique(shapes.part)]
    points = [np.concatenate(xys, axis=1) for xys in parts]
    apart = np.ones(len(shapes.rows), bool)
    for a in range(len(parts)):
        for b in range(a):
            low, high = np.maximum(points[a].min(1), points[b].min(1)), np.minimum(points[a].max(1), points[b].max(1))
            clear = (low >= high).any(1)
            for own, other in ((a, b), (b, a)):
                edges = np.concatenate([np.concatenate([xy[:, :-1], xy[:, 1:]], axis=2) for xy in parts[own]], axis=1)[:, :, None]
                near, far = (_turns(edges, points[k][:, None, :, 0], points[k][:, None, :, 1]) for k in (own, other))
                split = ((near >= 0).all(2) & (far <= 0).all(2)) | ((near <= 0).all(2) & (far >= 0).all(2))
                clear |= split.any(1)
            apart &= clear
    return apart


@F.arrow_udf(LOOK_TYPE)
def few_edges_look(wkb: pa.Array) -> pa.Array:
    """``crossings`` of the edges of each area shape, and whether its parts are plainly ``apart``. Both are null for a shape
    of more than ROW_EDGES edges or with a point twice in turn, which is left to joins of its edges."""
    looked, apart, found = np.zeros(len(wkb), bool), np.zeros(len(wkb), bool), []
    for whole in _alike(wkb):
        edges = sum(xy.shape[1] - 1 for xy in whole.xys)
        if not whole.xys or edges > ROW_EDGES or min(xy.shape[1] for xy in whole.xys) < 2:
            continue
        plain = np.ones(len(whole.rows), bool)
        for xy in whole.xys:
            plain &= (xy[:, 1:] != xy[:, :-1]).any(2).all(1)
        step = max(1, CELL_LIMIT // (edges + 1) ** 2)
        places = np.flatnonzero(plain)
        for start in range(0, len(places), step):
            shapes = whole.of(places[start : start + step])
            looked[shapes.rows] = True
            apart[shapes.rows] = _parts_apart(shapes)
            at, *values = _row_crossings(shapes)
            found.append((shapes.rows[at], *values))
    if found:
        rows, *values = (np.concatenate(c) for c in zip(*found))
    else:
        rows, values = np.zeros(0, int), [np.zeros(0)] * 7
    order = np.argsort(rows, kind="stable")
    fields = LOOK_TYPE["crossings"].dataType.elementType
    each = pa.StructArray.from_arrays(
        [pa.array(v[order], pa.int32() if k < 5 else pa.float64()) for k, v in enumerate(values)], fields.names
    )
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(wkb)))])
    crossings = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each, mask=pa.array(~looked))
    return pa.StructArray.from_arrays([crossings, pa.array(apart, pa.bool_(), mask=~looked)], LOOK_TYPE.names)


def _plain_rings(shapes: Alike) -> np.ndarray:
    """Shapes of which every ring is an outline that is closed, holds no point twice in turn, never turns straight back and
    plainly encloses something."""
    plain = np.ones(len(shapes.rows), bool)
    for xy in shapes.xys:
        step = xy[:, 1:] - xy[:, :-1]
        after = np.roll(step, -1, axis=1)
        straight = step[..., 0] * after[..., 1] == step[..., 1] * after[..., 0]
        back = straight & (step[..., 0] * after[..., 0] + step[..., 1] * after[..., 1] < 0)
        d = xy - xy[:, :1]
        terms = d[:, :-1, 0] * d[:, 1:, 1], d[:, 1:, 0] * d[:, :-1, 1]
        around, most = (terms[0] - terms[1]).sum(1), (np.abs(terms[0]) + np.abs(terms[1])).sum(1)
        plain &= (xy[:, 0] == xy[:, -1]).all(1) & (xy[:, 1:] != xy[:, :-1]).any(2).all(1)
        plain &= ~back.any(1) & (np.abs(around) > 1e-9 * most)
    return plain


@F.arrow_udf(T.BooleanType())
def plainly_legal(wkb: pa.Array) -> pa.Array:
    """Area shapes of at most ROW_EDGES edges and without holes that have no fault. Others may have none either."""
    legal = np.zeros(len(wkb), bool)
    for whole in _alike(wkb):
        edges = sum(xy.shape[1] - 1 for xy in whole.xys)
        if not whole.xys or whole.ring.any() or edges > ROW_EDGES or min(xy.shape[1] for xy in whole.xys) < 4:
            continue
        places = np.flatnonzero(_plain_rings(whole))
        step = max(1, CELL_LIMIT // (edges + 1) ** 2)
        for start in range(0, len(places), step):
            shapes = whole.of(places[start : start + step])
            clear = _parts_apart(shapes)
            clear[_row_crossings(shapes)[0]] = False
            legal[shapes.rows] = clear
    return pa.array(legal)


def _sweep(edges: np.ndarray, of_b: np.ndarray, shape: np.ndarray, bands: int) -> dict[str, np.ndarray]:
    """Areas of groups of equally many edges, which rise from (x1, y1) to (x2, y2): ``shape`` numbers their shapes in order."""
    rows, n = shape.shape
    x1, y1, x2, y2 = (edges[..., c] for c in range(4))
    other = np.triu(np.ones((n, n), bool), 1) & (shape[:, :, None] != shape[:, None])
    starts, ends = (_turns(edges[:, :, None], edges[:, None, :, c], edges[:, None, :, c + 1]) for c in (0, 2))
    back = starts.transpose(0, 2, 1), ends.transpose(0, 2, 1)
    row, a, b = np.nonzero(other & (starts * ends < 0) & (back[0] * back[1] < 0))
    s3, s4 = back[0][row, a, b], back[1][row, a, b]
    count = np.bincount(row, minlength=rows)
    crossed = np.full((rows, count.max(initial=0)), np.inf)
    crossed[row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)] = y1[row, a] + (y2 - y1)[row, a] * (s3 / (s3 - s4))
    bottom = y1.min(1)
    tall = np.maximum(y2.max(1) - bottom, 1e-6) / bands
    cuts = bottom[:, None] + np.arange(1, bands) * tall[:, None]
    heights = np.sort(np.concatenate([y1, y2, crossed, cuts], axis=1), axis=1)
    heights[:, 1:][heights[:, 1:] == heights[:, :-1]] = np.inf
    heights = np.sort(heights, axis=1)
    total = {name: np.zeros(rows) for name in SWEPT_TYPE.names[:3]}
    at = np.full((rows, 2), np.nan)
    for k in range(heights.shape[1] - 1):
        base, top = heights[:, k], heights[:, k + 1]
        on = np.flatnonzero(np.isfinite(top))
        if not len(on):
            break
        base, top = base[on], top[on]
        middle = (base + top) / 2
        e = edges[on]
        passes = (e[..., 1] < middle[:, None]) & (e[..., 3] > middle[:, None])
        x = e[..., 0] + (middle[:, None] - e[..., 1]) / (e[..., 3] - e[..., 1]) * (e[..., 2] - e[..., 0])
        x = np.where(passes, x, np.inf)
        order = np.argsort(x, axis=1, kind="stable")
        x, own, b = (np.take_along_axis(c, order, 1) for c in (x, shape[on], of_b[on]))
        step = np.zeros(own.shape, int)
        for s in range(own.max(initial=-1) + 1):
            mine = own == s
            step += np.where(mine, 2 * (np.cumsum(mine, 1) % 2) - 1, 0)
        in_a, in_b = np.cumsum(np.where(b, 0, step), 1)[:, :-1], np.cumsum(np.where(b, step, 0), 1)[:, :-1]
        wide = np.where(np.isfinite(x[:, 1:]), x[:, 1:] - np.where(np.isfinite(x[:, :-1]), x[:, :-1], 0.0), 0.0)
        area = wide * (top - base)[:, None]
        for name, inside in (("only_a", (in_a > 0) & (in_b == 0)), ("both", (in_a > 0) & (in_b > 0)), ("twice", in_a > 1)):
            total[name][on] += np.where(inside, area, 0.0).sum(1)
        doubled = (in_a > 1) & (area > 0)
        first = doubled.any(1) & np.isnan(at[on, 0])
        at[on[first], 0], at[on[first], 1] = middle[first], x[first, doubled[first].argmax(1)]
    return {**total, "y": at[:, 0], "x": at[:, 1]}


@F.arrow_udf(SWEPT_TYPE)
def swept_rows(edges: pa.Array, bands: pa.Array) -> pa.Array:
    """``edges.swept`` of groups in rows: lists of (of_b, owner, x1, y1, x2, y2) in order, and how many bands they are cut into."""
    bounds, each = _lists(edges)
    of_b, owner, *xy = (c.to_numpy(zero_copy_only=False) for c in each.flatten())
    xy, of_b = np.column_stack(xy), of_b.astype(bool)
    sizes, bands = np.diff(bounds), bands.to_numpy(zero_copy_only=False)
    found = {name: np.full(len(sizes), np.nan) for name in (*SWEPT_TYPE.names[:3], "y", "x")}
    # owners by number, so that an edge is of another shape than the one before it where the number differs
    changed = np.concatenate([[True], (owner[1:] != owner[:-1]) | (of_b[1:] != of_b[:-1])]) if len(owner) else np.zeros(0, bool)
    nth = np.cumsum(changed)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, CELL_LIMIT // (8 * n * n))
        for start in range(0, len(rows), step):
            own = rows[start : start + step]
            at = bounds[own][:, None] + np.arange(n)
            for name, values in _sweep(xy[at], of_b[at], nth[at] - nth[at[:, :1]], int(bands[own[0]])).items():
                found[name][own] = values
    place = pa.StructArray.from_arrays([pa.array(found["y"]), pa.array(found["x"])], ["y", "x"], mask=pa.array(np.isnan(found["y"])))
    return pa.StructArray.from_arrays([*[pa.array(found[n]) for n in SWEPT_TYPE.names[:3]], place], SWEPT_TYPE.names)


# -- facts ------------------------------------------------------------------------------


def _facts(data):
    if data is None:
        return ("missing", None, None, None, None, None, None, None, None)
    try:
        kind, parts = _parts(data)
        points = np.vstack([xy for rings in parts for xy in rings]) if parts else np.empty((0, 2))
        if len(points) and not np.isfinite(points).all():
            raise ValueError("coordinates are not finite")
    except (ValueError, KeyError, IndexError, struct.error):
        return ("unreadable", None, None, None, None, None, None, None, None)
    if not len(points):
        return ("missing", kind, None, None, None, None, None, None, None)
    surface = kind in (POLYGON, MULTIPOLYGON)
    low, high = points.min(0), points.max(0)
    return (
        "ok", kind,
        _area(parts) if surface else 0.0,
        _length(_edges(parts)) if kind in (LINESTRING, MULTILINESTRING) else 0.0,
        float(low[0]), float(low[1]), float(high[0]), float(high[1]),
        surface and _is_box(parts),
    )


# -- whole batches -----------------------------------------------------------------------


def _box_shapes(shapes: Alike) -> np.ndarray:
    """Which area shapes are boxes with upright sides."""
    if len(shapes.xys) != 1 or shapes.xys[0].shape[1] != 5:
        return np.zeros(len(shapes.rows), bool)
    xy = shapes.xys[0]
    moved = np.diff(xy, axis=1) != 0
    box = (moved.sum(2) == 1).all(1) & (moved[:, :-1, 0] != moved[:, 1:, 0]).all(1)
    return box & (xy[:, 0] == xy[:, 4]).all(1)


def _ring_areas(xy: np.ndarray) -> np.ndarray:
    d = xy - xy[:, :1]
    return np.abs(0.5 * (d[:, :-1, 0] * d[:, 1:, 1] - d[:, 1:, 0] * d[:, :-1, 1]).sum(1))


def _areas(shapes: Alike) -> np.ndarray:
    """Outlines less holes."""
    total = np.zeros(len(shapes.rows))
    for xy, ring in zip(shapes.xys, shapes.ring):
        total += _ring_areas(xy) if ring == 0 else -_ring_areas(xy)
    return total


MEASURES = FACTS_TYPE.names[2:8]
#: Points of a shape up to which extents are taken point by point over all shapes.
FEW_POINTS = 64


def _extents(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest coordinates of each shape."""
    if not 0 < points.shape[1] <= FEW_POINTS:
        return (points.min(1), points.max(1)) if points.shape[1] else (np.zeros((len(points), 2)),) * 2
    low, high = points[:, 0].copy(), points[:, 0].copy()
    for k in range(1, points.shape[1]):
        np.minimum(low, points[:, k], out=low)
        np.maximum(high, points[:, k], out=high)
    return low, high


def _batch_facts(wkb: pa.Array) -> dict[str, np.ndarray]:
    """FACTS_TYPE's columns of a batch; what a shape does not have is None or NaN."""
    n = len(wkb)
    facts = {name: np.full(n, np.nan) for name in MEASURES}
    facts["status"] = np.where(wkb.is_valid().to_numpy(zero_copy_only=False), "unreadable", "missing").astype(object)
    facts["kind"], facts["is_box"] = np.full(n, None, object), np.full(n, None, object)
    for shapes in _alike(wkb):
        points = shapes.points()
        low, high = _extents(points)
        finite = (np.isfinite(low) & np.isfinite(high)).all(1)  # a point that is not finite shows in an extent
        if not finite.all():
            shapes, points, low, high = shapes.of(finite), points[finite], low[finite], high[finite]
        rows = shapes.rows
        facts["kind"][rows] = shapes.kind
        if not points.shape[1]:
            facts["status"][rows] = "missing"
            continue
        surface = shapes.kind in (POLYGON, MULTIPOLYGON)
        facts["status"][rows] = "ok"
        facts["length"][rows] = 0.0
        if shapes.kind in (LINESTRING, MULTILINESTRING):
            edges = shapes.edges()
            facts["length"][rows] = np.hypot(edges[:, :, 2] - edges[:, :, 0], edges[:, :, 3] - edges[:, :, 1]).sum(1)
        facts["minx"][rows], facts["miny"][rows] = low[:, 0], low[:, 1]
        facts["maxx"][rows], facts["maxy"][rows] = high[:, 0], high[:, 1]
        box = _box_shapes(shapes) if surface else np.zeros(len(rows), bool)
        facts["is_box"][rows] = box
        # a box of a single polygon by its sides, so that equal boxes have equal areas wherever they lie
        sides = (high - low).prod(1)
        facts["area"][rows] = np.where(box & (shapes.kind == POLYGON), sides, _areas(shapes)) if surface else 0.0
    return facts


# -- column functions ------------------------------------------------------------------


def _nullable(values: np.ndarray) -> pa.Array:
    return pa.array(values, pa.float64(), mask=np.isnan(values))


@F.arrow_udf(FACTS_TYPE)
def geometry_facts(wkb: pa.Array) -> pa.Array:
    """Readability, kind, size and envelope of each geometry, in one pass."""
    facts = _batch_facts(wkb)
    columns = [pa.array(facts[n], pa.string()) for n in ("status", "kind")]
    columns += [_nullable(facts[n]) for n in MEASURES] + [pa.array(facts["is_box"], pa.bool_())]
    return pa.StructArray.from_arrays(columns, FACTS_TYPE.names)


@F.arrow_udf(RINGS_TYPE)
def rings(wkb: pa.Array) -> pa.Array:
    """Every ring, line or point of a shape with its coordinates; nothing for a shape that is missing or unreadable."""
    rows, nth, part, ring, sizes, blocks = ([np.zeros(0, int)] for _ in range(6))
    blocks = [np.empty((0, 2))]
    for shapes in _alike(wkb):
        for k, xy in enumerate(shapes.xys):
            whole = np.ones(len(shapes.rows), int)
            rows.append(shapes.rows)
            nth.append(whole * k)
            part.append(whole * shapes.part[k])
            ring.append(whole * shapes.ring[k])
            sizes.append(whole * xy.shape[1])
            blocks.append(xy.reshape(-1, 2))
    rows, nth, part, ring, sizes = (np.concatenate(c) for c in (rows, nth, part, ring, sizes))
    order = np.lexsort((nth, rows))
    begin = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    xy = np.concatenate(blocks)[np.repeat(begin - bounds[:-1], sizes) + np.arange(bounds[-1])]
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    points = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), points)
    each = pa.StructArray.from_arrays(
        [pa.array(part[order], pa.int32()), pa.array(ring[order], pa.int32()), points], ["part", "ring", "points"]
    )
    of_row = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(wkb)))])
    return pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), each)


def _box_edges(minx, miny, maxx, maxy) -> np.ndarray:
    xy = np.array([[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]])
    return np.hstack([xy[:-1], xy[1:]])


def _region(wkb, *box) -> np.ndarray:
    return _box_edges(*box) if wkb is None else _edges(_parts(wkb)[1])


@F.pandas_udf(T.DoubleType())
def shared_area(
    a: pd.Series, ax0: pd.Series, ay0: pd.Series, ax1: pd.Series, ay1: pd.Series,
    b: pd.Series, bx0: pd.Series, by0: pd.Series, bx1: pd.Series, by1: pd.Series,
) -> pd.Series:
    """Common area of two shapes; a NULL shape stands for its envelope."""
    width = np.minimum(ax1, bx1) - np.maximum(ax0, bx0)
    height = np.minimum(ay1, by1) - np.maximum(ay0, by0)
    result = (width.clip(lower=0) * height.clip(lower=0)).astype(float)
    for i in np.flatnonzero((a.notna() | b.notna()) & (result > 0)):
        result.iat[i] = _overlap(
            _region(a.iat[i], ax0.iat[i], ay0.iat[i], ax1.iat[i], ay1.iat[i]),
            _region(b.iat[i], bx0.iat[i], by0.iat[i], bx1.iat[i], by1.iat[i]),
        )
    return result


def _both(a: pa.Array, b: pa.Array) -> Iterator[tuple[Alike, Alike]]:
    """The rows of two columns where both hold a shape, by the layouts of both. A shape that cannot be read fails the query."""
    n = len(a)
    asked = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
    sides = []
    for wkb in (a, b):
        layouts, which, place = list(_alike(wkb)), np.full(n, -1), np.zeros(n, int)
        for k, shapes in enumerate(layouts):
            which[shapes.rows], place[shapes.rows] = k, np.arange(len(shapes.rows))
        for row in np.flatnonzero(asked & (which < 0)):
            _parts(wkb[int(row)].as_py())  # raises what is wrong with it
        sides.append((layouts, which, place))
    (layouts_a, of_a, at_a), (layouts_b, of_b, at_b) = sides
    rows = np.flatnonzero(asked)
    pair = of_a[rows] * max(1, len(layouts_b)) + of_b[rows]
    for key in np.unique(pair):
        own = rows[pair == key]
        yield layouts_a[of_a[own[0]]].of(at_a[own]), layouts_b[of_b[own[0]]].of(at_b[own])


def _dealt(a: Alike, b: Alike, cells: int, many, one) -> np.ndarray:
    """``many`` over slices of pairs of shapes of about CELL_LIMIT cells; large shapes pair by pair by ``one``."""
    found, step = np.empty(len(a.rows)), CELL_LIMIT // max(1, cells)
    if step < 2:
        for i in range(len(found)):
            found[i] = one(i)
    for start in range(0, len(found) if step > 1 else 0, max(1, step)):
        found[start : start + step] = many(slice(start, start + step))
    return found


def _by_pairs(a: pa.Array, b: pa.Array, measure) -> pa.Array:
    found, known = np.zeros(len(a)), np.zeros(len(a), bool)
    for shapes_a, shapes_b in _both(a, b):
        found[shapes_a.rows], known[shapes_a.rows] = measure(shapes_a, shapes_b), True
    return pa.array(found, pa.float64(), mask=~known)


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    def measure(a: Alike, b: Alike) -> np.ndarray:
        p, q = a.edges(), b.edges()
        na, nb = p.shape[1], q.shape[1]
        if not na or not nb:
            return np.zeros(len(p))
        slabs = 2 * (na + nb) + na * nb + na * na + nb * nb
        return _dealt(a, b, slabs * (na + nb), lambda s: _overlaps(p[s], q[s]), lambda i: _overlap(p[i], q[i]))

    return _by_pairs(a, b, measure)


@F.arrow_udf(T.DoubleType())
def area(wkb: pa.Array) -> pa.Array:
    return _nullable(_batch_facts(wkb)["area"])


@F.arrow_udf(T.DoubleType())
def length_outside(line: pa.Array, region: pa.Array) -> pa.Array:
    """Length of each line outside its region."""

    def measure(a: Alike, b: Alike) -> np.ndarray:
        p, q = a.edges(), b.edges()
        cells = 3 * (q.shape[1] + 1) * max(1, q.shape[1])
        return _dealt(a, b, cells, lambda s: _lengths_outside(p[s], q[s]), lambda i: _length_outside(p[i], q[i]))

    return _by_pairs(line, region, measure)


@F.arrow_udf(T.DoubleType())
def distance_outside(point: pa.Array, region: pa.Array) -> pa.Array:
    """Distance of each point from its region, 0 inside or on the edge."""

    def measure(a: Alike, b: Alike) -> np.ndarray:
        xy, edges = a.points(), b.edges()

        def one(i: int) -> float:
            return float(np.where(_inside(edges[i], xy[i]), 0.0, _distances(edges[i], xy[i])).max())

        def many(s: slice) -> np.ndarray:
            within, away = _insides(edges[s], xy[s])
            return np.where(within, 0.0, away).max(1)

        return _dealt(a, b, xy.shape[1] * edges.shape[1], many, one)

    return _by_pairs(point, region, measure)


def _binary(block: np.ndarray) -> pa.Array:
    """Values of one length, from an array of bytes with a row each."""
    bounds = np.arange(len(block) + 1, dtype=np.int32) * block.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(block), [None, pa.py_buffer(bounds), pa.py_buffer(block.tobytes())])


def _encoder(kind: int, header: bytes, points: int):
    prefix = np.frombuffer(struct.pack("<BI", 1, kind) + header, np.uint8)

    def encode(columns: list[pa.Array]) -> pa.Array:
        # a null coordinate is one that is not a number
        xy = np.column_stack([c.to_numpy(zero_copy_only=False).astype("<f8") for c in columns])
        block = np.empty((len(xy), len(prefix) + 16 * points), np.uint8)
        block[:, : len(prefix)] = prefix
        block[:, len(prefix) :] = np.ascontiguousarray(xy).view(np.uint8)
        return _binary(block)

    return encode


_BOX = _encoder(3, struct.pack("<II", 1, 5), 5)
_LINE = _encoder(2, struct.pack("<I", 2), 2)
_POINT = _encoder(1, b"", 1)


@F.arrow_udf(T.BinaryType())
def box_wkb(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    return _BOX([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0])


@F.arrow_udf(T.BinaryType())
def line_wkb(x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
    return _LINE([x0, y0, x1, y1])


@F.arrow_udf(T.BinaryType())
def point_wkb(x: pa.Array, y: pa.Array) -> pa.Array:
    return _POINT([x, y])


def _lists(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Bounds of the lists of a batch and what is in them."""
    if values.null_count:
        raise ValueError("a shape without its points")
    bounds = values.offsets.to_numpy()
    return bounds - bounds[0], values.flatten()


def _headed(data: np.ndarray, bounds: np.ndarray, groups: np.ndarray, head: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """Items of these bytes and bounds in groups, each with ``head`` and its number of items before it."""
    count = np.diff(groups).astype("<u4").view(np.uint8).reshape(-1, 4)
    heads = np.concatenate([np.tile(np.frombuffer(head, np.uint8), (len(count), 1)), count], axis=1)
    around = bounds[groups] + heads.shape[1] * np.arange(len(groups))
    out, plain = np.empty(around[-1], np.uint8), np.ones(around[-1], bool)
    at = around[:-1, None] + np.arange(heads.shape[1])
    out[at], plain[at] = heads, False
    out[plain] = data
    return out, around


def _coordinates(points: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x, y = (c.to_numpy(zero_copy_only=False) for c in points.flatten())
    if points.null_count or any(c.null_count for c in points.flatten()):
        raise ValueError("a point without its coordinates")
    return np.column_stack([x, y]).astype("<f8").view(np.uint8).ravel(), 16 * np.arange(len(points) + 1)


def _binaries(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    bounds = pa.py_buffer(bounds.astype(np.int32))
    return pa.BinaryArray.from_buffers(pa.binary(), len(bounds) // 4 - 1, [None, bounds, pa.py_buffer(data)])


@F.arrow_udf(T.BinaryType())
def multipolygon_wkb(parts: pa.Array) -> pa.Array:
    """A MULTIPOLYGON from array<polygon>; a polygon is array<ring>, a ring array<struct<x,y>>."""
    by_shape, polygons = _lists(parts)
    by_part, found = _lists(polygons)
    by_ring, points = _lists(found)
    rings = _headed(*_coordinates(points), by_ring)
    polygons = _headed(*rings, by_part, struct.pack("<BI", 1, 3))
    return _binaries(*_headed(*polygons, by_shape, struct.pack("<BI", 1, 6)))


@F.arrow_udf(T.BinaryType())
def linestring_wkb(points: pa.Array) -> pa.Array:
    """A LINESTRING from array<struct<x,y>>."""
    by_line, points = _lists(points)
    return _binaries(*_headed(*_coordinates(points), by_line, struct.pack("<BI", 1, 2)))


@F.arrow_udf(T.BinaryType())
def polygon_wkb(rings: pa.Array) -> pa.Array:
    """A POLYGON from array<ring>."""
    by_shape, found = _lists(rings)
    by_ring, points = _lists(found)
    return _binaries(*_headed(*_headed(*_coordinates(points), by_ring), by_shape, struct.pack("<BI", 1, 3)))


# -- native measures ---------------------------------------------------------------------


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring given as array<struct<x,y>>, without leaving the JVM."""
    x0, y0 = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    terms = F.zip_with(
        F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1),
        lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0),
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda total, term: total + term)) / 2


def polygon_area(rings: Column) -> Column:
    """Area of a polygon given as array<ring>: its outline less its holes."""
    holes = F.transform(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), ring_area)
    return ring_area(F.get(rings, 0)) - F.aggregate(holes, F.lit(0.0), lambda total, hole: total + hole)


def multipolygon_area(parts: Column) -> Column:
    """Area of a MULTIPOLYGON given as array<polygon>; a polygon is array<ring>, a ring array<struct<x,y>>."""
    return F.aggregate(F.transform(parts, polygon_area), F.lit(0.0), lambda total, part: total + part)


def path_length(path: Column) -> Column:
    """Length of a line given as array<struct<x,y>>."""
    steps = F.zip_with(
        F.slice(path, 1, F.size(path) - 1), F.slice(path, 2, F.size(path) - 1),
        lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]),
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, step: total + step)


def multipath_length(paths: Column) -> Column:
    """Length of a MULTILINESTRING given as array<line>."""
    return F.aggregate(F.transform(paths, path_length), F.lit(0.0), lambda total, path: total + path)


SQL_NAMES = {
    "habitat_area": area,
    "habitat_overlap_area": overlap_area,
    "habitat_length_outside": length_outside,
    "habitat_distance_outside": distance_outside,
    "habitat_geometry_facts": geometry_facts,
}


def register(spark: SparkSession) -> None:
    """Make the geometry functions callable from SQL."""
    for name, function in SQL_NAMES.items():
        spark.udf.register(name, function)
