"""Regions given by users: parsing, validity, normal form, hash, point tests.

A region is a list of polygons; a polygon is a list of closed rings, the outer one first.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

import numpy as np

from geoloom.errors import InvalidGeometryFilter
from geoloom.functions.topology import area, oriented, points_in_ring
from geoloom.schema import PLACES

Ring = list[tuple[float, float]]
Region = list[list[Ring]]

#: Digits of a geohash.
_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def from_box(box: Iterable[float] | str) -> Region:
    """(x_min, y_min, x_max, y_max), also as comma-separated text."""
    values = [float(v) for v in (box.split(",") if isinstance(box, str) else box)]
    if len(values) != 4:
        raise ValueError("A box needs four numbers: x_min, y_min, x_max, y_max.")
    a, b, c, d = values
    return [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]


def geohash_box(text: str) -> tuple[float, float, float, float]:
    lon, lat, even = [-180.0, 180.0], [-90.0, 90.0], True
    for ch in text.strip().lower():
        if ch not in _BASE32:
            raise ValueError(f"Not a geohash: {text!r}")
        for bit in range(4, -1, -1):
            side = lon if even else lat
            side[1 - (_BASE32.index(ch) >> bit & 1)] = sum(side) / 2
            even = not even
    return lon[0], lat[0], lon[1], lat[1]


def from_geohash(text: str) -> Region:
    """Comma-separated geohashes; their boxes stand side by side."""
    return [p for part in text.split(",") for p in from_box(geohash_box(part))]


def from_wkt(text: str) -> Region:
    m = re.fullmatch(r"\s*(?:SRID=\d+;)?\s*([A-Za-z]+)\s*(?:Z\s*)?(.*?)\s*", text, re.S)
    if not m:
        raise ValueError(f"Not WKT: {text[:80]!r}")
    kind, body = m[1].upper(), m[2]
    if body.upper() == "EMPTY":
        return []
    if kind == "GEOMETRYCOLLECTION":
        return [p for part in _split(body[1:-1]) for p in from_wkt(part)]
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        raise InvalidGeometryFilter(f"{kind} has no area.")
    ring = lambda t: [tuple(float(v) for v in p.split()[:2]) for p in t.strip()[1:-1].split(",")]
    polygon = lambda t: [ring(r) for r in _split(t.strip()[1:-1])]
    return [polygon(body)] if kind == "POLYGON" else [polygon(p) for p in _split(body[1:-1])]


def _split(text: str) -> list[str]:
    """At commas outside brackets."""
    out, depth, begin = [], 0, 0
    for k, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[begin:k].strip())
            begin = k + 1
    return [*out, text[begin:].strip()]


def from_geojson(data: str | dict) -> Region:
    """Geometry, Feature, FeatureCollection or GeometryCollection."""
    data = json.loads(data) if isinstance(data, str) else data
    kind = data.get("type")
    if kind == "FeatureCollection":
        return [p for f in data["features"] for p in from_geojson(f)]
    if kind == "Feature":
        return from_geojson(data["geometry"])
    if kind == "GeometryCollection":
        return [p for g in data["geometries"] for p in from_geojson(g)]
    rings = lambda rs: [[tuple(map(float, p[:2])) for p in r] for r in rs]
    if kind == "Polygon":
        return [rings(data["coordinates"])]
    if kind == "MultiPolygon":
        return [rings(p) for p in data["coordinates"]]
    raise InvalidGeometryFilter(f"{kind} has no area.")


def check_region(region: Region) -> None:
    """InvalidGeometryFilter if the region is empty or a part has no area."""
    if not region:
        raise InvalidGeometryFilter("The region is empty.")
    if any(not p or len(p[0]) < 4 or polygon_area(p) == 0 for p in region):
        raise InvalidGeometryFilter("The region has a part without area.")


def polygon_area(polygon: list[Ring]) -> float:
    return abs(area(polygon[0])) - sum(abs(area(r)) for r in polygon[1:])


def bounds(region: Region) -> tuple[float, float, float, float]:
    p = np.array([q for polygon in region for q in polygon[0]], float)
    return (*(float(v) for v in p.min(axis=0)), *(float(v) for v in p.max(axis=0)))


def contains(region: Region, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points are inside or on the border."""
    points = np.stack([x, y], axis=1)
    hit = np.zeros(len(points), bool)
    for polygon in region:
        a = np.asarray(polygon[0], float)
        near = np.flatnonzero(~hit & (points >= a.min(axis=0)).all(axis=1) & (points <= a.max(axis=0)).all(axis=1))
        if not len(near):
            continue
        inside = points_in_ring(points[near], a) >= 0
        for hole in polygon[1:]:
            inside &= points_in_ring(points[near], np.asarray(hole, float)) <= 0
        hit[near[inside]] = True
    return hit


def _centroid(ring: Ring) -> tuple[float, float]:
    p = np.asarray(ring, float)
    cross = p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]
    total = cross.sum() * 3
    if not total:
        return tuple(p[:-1].mean(axis=0))
    return float(((p[:-1, 0] + p[1:, 0]) * cross).sum() / total), float(((p[:-1, 1] + p[1:, 1]) * cross).sum() / total)


def normal_ring(ring: Ring) -> Ring:
    """Counter-clockwise from the smallest point, at the model's precision."""
    open_ = oriented(ring)[:-1]
    at = min(range(len(open_)), key=lambda k: open_[k])
    turned = [*open_[at:], *open_[: at + 1]]
    return [(round(x, PLACES), round(y, PLACES)) for x, y in turned]


def normal_form(region: Region) -> Region:
    """Equal for regions that differ in ring starts, directions and the order of holes and parts."""
    parts = [[normal_ring(p[0]), *sorted(map(normal_ring, p[1:]), key=_centroid)] for p in region]
    return sorted(parts, key=lambda p: _centroid(p[0]))


def to_wkt(region: Region) -> str:
    ring = lambda r: "(" + ", ".join(f"{x:.16g} {y:.16g}" for x, y in r) + ")"
    parts = ["(" + ", ".join(map(ring, p)) + ")" for p in region]
    return f"POLYGON {parts[0]}" if len(parts) == 1 else "MULTIPOLYGON (" + ", ".join(parts) + ")"


def region_hash(region: Region | None) -> str:
    """Eight hex digits of the normal form, or ``noclip``."""
    return "noclip" if region is None else hashlib.sha256(to_wkt(normal_form(region)).encode()).hexdigest()[:8]


def geodesic_area_km2(region: Region) -> float:
    """Area on the WGS84 authalic sphere."""
    radius, total = 6371.0072, 0.0
    for polygon in region:
        for k, ring in enumerate(polygon):
            p = np.radians(np.asarray(ring, float))
            a = abs(float(((p[1:, 0] - p[:-1, 0]) * (2 + np.sin(p[:-1, 1]) + np.sin(p[1:, 1]))).sum())) * radius**2 / 2
            total += a if not k else -a
    return round(total * 1e6) / 1e6
