"""Sewing of lines into rings and nesting of rings into polygons, for the members of one relation.

Pure Python on coordinates, for regions on the driver and for sessions without :mod:`geoloom.functions.jts`, which does the same
by overlay.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

Point = tuple[float, float]
Line = list[Point]


def without_repeats(line: Line) -> Line:
    return [p for k, p in enumerate(line) if not k or p != line[k - 1]]


def sew(lines: list[Line]) -> list[Line]:
    """Join lines end to end wherever exactly two ends meet; the result is maximal lines and rings.

    Lines without length vanish. The order and direction of the input don't change the set of results but for where a
    ring starts.
    """
    parts = [w for w in map(without_repeats, lines) if len(w) > 1]
    at: dict[Point, list[int]] = defaultdict(list)
    for k, part in enumerate(parts):
        at[part[0]].append(k)
        at[part[-1]].append(k)
    used, out = [False] * len(parts), []

    def grow(line: Line) -> Line:
        """Extend at the end while exactly two ends meet there."""
        while line[0] != line[-1]:
            ends = at[line[-1]]
            nxt = [k for k in ends if not used[k]]
            if len(ends) != 2 or len(nxt) != 1:
                break
            used[nxt[0]] = True
            more = parts[nxt[0]]
            line = line + (more[1:] if more[0] == line[-1] else more[-2::-1])
        return line

    for k, part in enumerate(parts):
        if not used[k]:
            used[k] = True
            line = grow(part)
            out.append(grow(line[::-1]) if line[0] != line[-1] else line)
    return out


def area(ring: Line) -> float:
    p = np.asarray(ring, float)
    p = p - p[0]
    return float(p[:-1, 0] @ p[1:, 1] - p[1:, 0] @ p[:-1, 1]) / 2


def oriented(ring: Line, ccw: bool = True) -> Line:
    return ring if (area(ring) > 0) == ccw else ring[::-1]


def points_in_ring(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """1 inside, 0 on the border, -1 outside, for each point."""
    a, b = ring[:-1], ring[1:]
    out = np.empty(len(points), np.int64)
    for k in range(0, len(points), max(1, 4_000_000 // max(1, len(a)))):
        p = points[k : k + max(1, 4_000_000 // max(1, len(a)))]
        x, y = p[:, :1], p[:, 1:]
        cross = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) - (b[:, 1] - a[:, 1]) * (x - a[:, 0])
        on = (cross == 0) & (x >= np.minimum(a[:, 0], b[:, 0])) & (x <= np.maximum(a[:, 0], b[:, 0])) & (y >= np.minimum(a[:, 1], b[:, 1])) & (y <= np.maximum(a[:, 1], b[:, 1]))
        up = a[:, 1] <= y
        odd = np.where(up & (b[:, 1] > y) & (cross > 0), 1, 0) + np.where(~up & (b[:, 1] <= y) & (cross < 0), 1, 0)
        out[k : k + len(p)] = np.where(on.any(axis=1), 0, np.where(odd.sum(axis=1) % 2 == 1, 1, -1))
    return out


def rings_cross(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether segments of two rings cross properly."""
    if a[:, 0].max() < b[:, 0].min() or b[:, 0].max() < a[:, 0].min() or a[:, 1].max() < b[:, 1].min() or b[:, 1].max() < a[:, 1].min():
        return False
    side = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    p, q = b[None, :-1], b[None, 1:]
    for k in range(0, len(a) - 1, max(1, 2_000_000 // len(b))):
        s, e = a[k : min(len(a) - 1, k + max(1, 2_000_000 // len(b))), None], a[k + 1 : min(len(a) - 1, k + max(1, 2_000_000 // len(b))) + 1, None]
        if ((side(s, e, p) * side(s, e, q) < 0) & (side(p, q, s) * side(p, q, e) < 0)).any():
            return True
    return False


def ring_within(inner: Line, outer: Line) -> bool:
    """No point of ``inner`` outside ``outer``, some inside, and no crossing."""
    i, o = np.asarray(inner, float), np.asarray(outer, float)
    mid = np.concatenate([i[:-1], (i[:-1] + i[1:]) / 2])
    where = points_in_ring(mid, o)
    if (where < 0).any() or rings_cross(i, o):
        return False
    return bool((where > 0).any()) or abs(area(inner)) <= abs(area(outer))


def polygons(outers: list[Line], inners: list[Line]) -> list[list[Line]]:
    """Each outer ring with the inner rings within it; inner rings within none are dropped.

    For rings that don't cross. Of nested outer rings the outermost stand for their union.
    """
    top = [r for k, r in enumerate(outers) if not any(j != k and ring_within(r, o) and (not ring_within(o, r) or j < k) for j, o in enumerate(outers))]
    out = []
    for ring in top:
        holes = [i for i in inners if ring_within(i, ring)]
        out.append([oriented(ring), *[oriented(h, ccw=False) for h in holes if abs(area(h)) > 0]])
    return out
