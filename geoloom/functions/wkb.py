"""Well-known binary: vectorised encoders for points, lines and rings, and a decoder."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)
NAMES = {POINT: "Point", LINE: "LineString", POLYGON: "Polygon", MULTI_POINT: "MultiPoint", MULTI_LINE: "MultiLineString", MULTI_POLYGON: "MultiPolygon", COLLECTION: "GeometryCollection"}

Ring = list[tuple[float, float]]


def encode_points(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    out = np.zeros(len(x), np.dtype([("o", "u1"), ("t", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    out["o"], out["t"], out["x"], out["y"] = 1, POINT, x, y
    data = out.tobytes()
    return [data[k : k + 21] for k in range(0, len(data), 21)]


def encode_line(points: np.ndarray) -> bytes:
    return struct.pack("<BII", 1, LINE, len(points)) + points.astype("<f8").tobytes()


def encode_polygon(rings: list) -> bytes:
    parts = [struct.pack("<BII", 1, POLYGON, len(rings))]
    for ring in rings:
        ring = np.asarray(ring, "<f8").reshape(-1, 2)
        parts += [struct.pack("<I", len(ring)), ring.tobytes()]
    return b"".join(parts)


def encode_polygons(polygons: list[list]) -> bytes:
    """A polygon, or a multipolygon of several."""
    if len(polygons) == 1:
        return encode_polygon(polygons[0])
    return struct.pack("<BII", 1, MULTI_POLYGON, len(polygons)) + b"".join(map(encode_polygon, polygons))


def geometry_type(data: bytes) -> str:
    return NAMES[int.from_bytes(data[1:5], "little" if data[0] else "big") & 0xFF]


def decode(data: bytes) -> tuple[str, list]:
    """(type, coordinates) with the nesting of GeoJSON; a collection holds such pairs."""
    out, _ = _decode(memoryview(data), 0)
    return out


def _decode(data: memoryview, at: int) -> tuple[tuple[str, list], int]:
    order = "<" if data[at] else ">"
    (kind,) = struct.unpack_from(order + "I", data, at + 1)
    at += 5

    def points(at: int) -> tuple[Ring, int]:
        (n,) = struct.unpack_from(order + "I", data, at)
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
        return list(zip(flat[::2], flat[1::2])), at + 4 + 16 * n

    if kind == POINT:
        return ("Point", list(struct.unpack_from(order + "2d", data, at))), at + 16
    if kind == LINE:
        line, at = points(at)
        return ("LineString", line), at
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    parts = []
    for _ in range(n):
        part, at = points(at) if kind == POLYGON else _decode(data, at)
        parts.append(part)
    if kind in (MULTI_POINT, MULTI_LINE, MULTI_POLYGON):
        parts = [p[1] for p in parts]
    return (NAMES[kind], parts), at


def to_wkt(data: bytes | None) -> str | None:
    if data is None:
        return None
    kind, parts = decode(data)
    return _wkt(kind, parts)


def _text(value: float) -> str:
    return f"{value:.7f}".rstrip("0").rstrip(".")


def _wkt(kind: str, parts: list) -> str:
    pair = lambda p: f"{_text(p[0])} {_text(p[1])}"
    line = lambda ps: "(" + ", ".join(map(pair, ps)) + ")"
    rings = lambda rs: "(" + ", ".join(map(line, rs)) + ")"
    if not parts:
        return f"{kind.upper()} EMPTY"
    body = {
        "Point": lambda: f"({pair(parts)})", "LineString": lambda: line(parts), "Polygon": lambda: rings(parts),
        "MultiPoint": lambda: "(" + ", ".join(f"({pair(p)})" for p in parts) + ")", "MultiLineString": lambda: "(" + ", ".join(map(line, parts)) + ")",
        "MultiPolygon": lambda: "(" + ", ".join(map(rings, parts)) + ")", "GeometryCollection": lambda: "(" + ", ".join(_wkt(*p) for p in parts) + ")",
    }
    return f"{kind.upper()} {body[kind]()}"


@F.pandas_udf(T.BinaryType())
def points_wkb(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(encode_points(x.to_numpy(float), y.to_numpy(float)))


@F.pandas_udf(T.BinaryType())
def ways_wkb(xs: pd.Series, ys: pd.Series, is_area: pd.Series) -> pd.Series:
    """Lines, and polygons of one ring; coordinates as two arrays."""
    out = []
    for x, y, area in zip(xs, ys, is_area):
        points = np.stack([x, y], axis=1)
        out.append(encode_polygon([points]) if area else encode_line(points))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def wkb_to_wkt(data: pd.Series) -> pd.Series:
    return data.map(to_wkt)


def wkb_type(geometry: str) -> Column:
    """Name of a shape's type, from its header; shapes are little-endian."""
    names = F.array(*[F.lit(NAMES[k]) for k in range(1, 8)])
    return F.get(names, F.conv(F.hex(F.substring(geometry, 2, 1)), 16, 10).cast("int") - 1)


def envelope_of(data: bytes) -> tuple[float, float, float, float]:
    """x_min, y_min, x_max, y_max; of a polygon its outer ring says it all."""
    if data[0] == 1 and data[1] in (POINT, LINE, POLYGON):
        at = {POINT: 5, LINE: 9, POLYGON: 13}[data[1]]
        n = 1 if data[1] == POINT else int.from_bytes(data[at - 4 : at], "little") if len(data) > at else 0
        if n:
            p = np.frombuffer(data, "<f8", 2 * n, at).reshape(n, 2)
            return (*p.min(axis=0), *p.max(axis=0))

    def flat(kind: str, parts: list):
        if kind == "Point":
            yield parts
        elif kind == "GeometryCollection":
            for p in parts:
                yield from flat(*p)
        else:
            todo = [parts]
            while todo:
                x = todo.pop()
                if isinstance(x, tuple):
                    yield x
                elif x and isinstance(x[0], float):
                    yield x
                else:
                    todo += x

    p = np.array(list(flat(*decode(data))), float).reshape(-1, 2)
    return (*p.min(axis=0), *p.max(axis=0)) if len(p) else (float("nan"),) * 4


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("x_min", "y_min", "x_max", "y_max")]))
def wkb_envelope(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([envelope_of(d) for d in data], columns=["x_min", "y_min", "x_max", "y_max"], dtype=float)
