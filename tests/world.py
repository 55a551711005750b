"""A hand-made world with one element for each rule."""

from __future__ import annotations


def node(i, lon, lat, **tags):
    return {"kind": "node", "id": i, "lon": float(lon), "lat": float(lat), "tags": tags or None}


def way(i, refs, **tags):
    return {"kind": "way", "id": i, "refs": refs, "tags": tags or None}


def relation(i, members, **tags):
    return {"kind": "relation", "id": i, "refs": [m[0] for m in members], "ref_roles": [m[1] for m in members], "ref_types": [m[2] if len(m) > 2 else "way" for m in members], "tags": tags or None}


def square(first: int, x: float, y: float, size: float):
    """Four nodes of a square, and the refs of its ring."""
    nodes = [node(first, x, y), node(first + 1, x + size, y), node(first + 2, x + size, y + size), node(first + 3, x, y + size)]
    return nodes, [first, first + 1, first + 2, first + 3, first]


def world() -> list[dict]:
    nodes = [node(1, 1.0, 1.0, amenity="bench"), node(2, 1.5, 1.5, created_by="x"), {**node(3, 0, 0, amenity="cafe")}]
    nodes[2]["lat"] = nodes[2]["lon"] = None
    a, ring = square(100, 0.0, 0.0, 4.0)
    b, hole = square(110, 1.0, 1.0, 1.0)
    c, far = square(120, 20.0, 20.0, 2.0)
    nodes += a + b + c
    multi = dict(type="multipolygon", landuse="forest")
    ways = [
        way(10, ring, building="yes"), way(11, ring, building="yes", area="no"), way(12, ring, highway="residential"), way(13, ring, highway="services"),
        way(14, ring, natural="cliff"), way(15, ring, natural="wood"), way(16, [100, 999, 102], highway="path"), way(17, [100], highway="path"),
        way(18, [100, 101, 100], building="yes"), way(19, [120, 121], highway="track"), way(20, ring, area="yes"), way(21, [100, 120], highway="road"),
        way(50, [100, 101]), way(51, [102, 101]), way(52, [102, 103, 100]), way(53, hole), way(54, far), way(55, [120, 121, 122]), way(56, [100, 101, 102, 103]), way(57, [100, 101, 102]),
    ]
    relations = [
        relation(30, [(50, "outer"), (51, "outer"), (52, "outer"), (53, "inner")], **multi),
        relation(31, [(50, None), (51, None), (52, None)], **multi),
        relation(32, [(10, "inner")], **multi),
        relation(33, [(50, "outer"), (55, "outer"), (56, "outer")], **multi),
        relation(34, [(10, "outer"), (54, "inner")], **multi),
        relation(35, [(10, "outer"), (54, "outer")], **multi),
        relation(36, [(10, "outer")], type="route", name="r"),
        relation(37, [(10, "outer"), (16, "outer")], **multi),
        relation(38, [(1, "label", "node"), (10, "outer")], **multi),
        relation(39, [(10, "outer"), (56, "label")], **multi),
        relation(40, [(10, "outer"), (57, "label")], **multi),
        relation(41, [(10, "outer"), (54, "")], **multi),
    ]
    return nodes + ways + relations


#: What the world gives without a filter.
EXPECTED = {
    "node/1": "POINT (1 1)",
    **{f"way/{k}": "POLYGON" for k in (10, 13, 15)},
    **{f"way/{k}": "LINESTRING" for k in (11, 12, 14, 18, 19, 21)},
    **{f"relation/{k}": "POLYGON" for k in (30, 31, 32, 34, 38, 40)},
    **{f"relation/{k}": "MULTIPOLYGON" for k in (35, 41)},
}
