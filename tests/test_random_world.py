"""A random world against rules spelled out in plain Python, with and without filters and regions."""

from __future__ import annotations

import random

import pytest
from test_features import frame, features
from world import node, relation, square, way

from geoloom.functions import region as regions
from geoloom.plans import references
from geoloom.schema import METADATA_KEYS, RELATION_TYPES

TAGS = [{}, {"building": "yes"}, {"highway": "path"}, {"area": "no", "building": "yes"}, {"source": "x"}, {"natural": "wood"}, {"natural": "cliff"}, {"area": "yes"}]


def random_world(seed: int):
    rng = random.Random(seed)
    elements, rings = [], []
    for k in range(40):
        nodes, ring = square(10 * k + 1, rng.randrange(-20, 20) * 3.0, rng.randrange(-20, 20) * 3.0, 2.0)
        elements += [{**n, "tags": rng.choice([None, {"amenity": "x"}, {"note": "y"}])} for n in nodes]
        rings.append(ring)
    ways = []
    for k in range(80):
        ring = list(rng.choice(rings))
        refs = rng.choice([ring, ring[: rng.randrange(1, 5)], [*ring[:2], 9999], rng.sample(range(1, 400, 10), 3)])
        ways.append(way(k + 1, refs, **rng.choice(TAGS)))
    relations = [relation(k + 1, [(rng.randrange(1, 85), rng.choice(["outer", None])) for _ in range(rng.randrange(1, 3))], type=rng.choice([*RELATION_TYPES, "route"]), **rng.choice(TAGS)) for k in range(60)]
    return elements + ways + relations


def expected(elements, wanted=lambda tags: True, inside=None):
    """Feature ids by the rules: parts that are there, tags left, a vertex in the region, closed parts."""
    at = {e["id"]: (e["lon"], e["lat"]) for e in elements if e["kind"] == "node"}
    ways = {e["id"]: e for e in elements if e["kind"] == "way" and len(e["refs"]) >= 2}
    whole = {i for i, e in ways.items() if all(r in at for r in e["refs"])}
    hit = {i for i, e in ways.items() if inside is None or any(r in at and inside(*at[r]) for r in e["refs"])}
    left = lambda e: {k: v for k, v in (e["tags"] or {}).items() if k not in METADATA_KEYS}
    asked = lambda e: bool(e["tags"]) and wanted(e["tags"]) and bool(left(e))
    out = {f"node/{e['id']}" for e in elements if e["kind"] == "node" and asked(e) and (inside is None or inside(e["lon"], e["lat"]))}
    out |= {f"way/{i}" for i in whole & hit if asked(ways[i])}
    for e in elements:
        if e["kind"] != "relation" or e["tags"]["type"] not in RELATION_TYPES or not asked(e) or not wanted(e["tags"]):
            continue
        if not any(r in hit for r in e["refs"]) or not all(r in whole for r in e["refs"]):
            continue
        lines = [[at[n] for n in ways[r]["refs"]] for r in e["refs"]]
        closed = closes(lines)
        if closed:
            out.add(f"relation/{e['id']}")
    return out


def closes(lines):
    """Whether the lines, joined where just two ends meet, leave rings only (parts of under four points aside), at least one."""
    lines = [list(w) for w in lines]
    done = False
    while not done:
        done = True
        ends: dict = {}
        for k, w in enumerate(lines):
            for p in (w[0], w[-1]):
                ends.setdefault(p, []).append(k)
        for p, ks in ends.items():
            if len(ks) == 2 and ks[0] != ks[1]:
                a, b = lines[ks[0]], lines[ks[1]]
                a, b = (a if a[-1] == p else a[::-1]), (b if b[0] == p else b[::-1])
                lines = [w for k, w in enumerate(lines) if k not in ks] + [a + b[1:]]
                done = False
                break
    parts = [w for w in lines if len(w) >= 4]
    return bool(parts) and all(w[0] == w[-1] for w in parts)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_world(spark, seed):
    elements = random_world(seed)
    df = frame(spark, elements).repartition(5)
    assert set(features(df)) == expected(elements)
    box = (-20.0, -15.0, 25.0, 18.0)
    inside = lambda x, y: box[0] <= x <= box[2] and box[1] <= y <= box[3]
    assert set(features(df, region=regions.from_box(box))) == expected(elements, inside=inside)
    assert set(features(df, flat={"building": True})) == expected(elements, lambda t: "building" in t)
    assert set(features(df, flat={"highway": True, "natural": "w*", "area": False}, region=regions.from_box(box))) == expected(elements, lambda t: ("highway" in t or t.get("natural", "").startswith("w")) and "area" not in t, inside)


@pytest.mark.parametrize("wide", [0.0, 2.0])
@pytest.mark.parametrize("box", [(-20.0, -15.0, 25.0, 18.0), (-170.0, -80.0, 5.0, 18.0), (100.0, 10.0, 110.0, 20.0)])
def test_a_region_gives_the_same_by_either_plan(spark, monkeypatch, wide, box):
    """From a share of the globe on, the join of points tells what is inside; below it, ways are looked at beforehand."""
    monkeypatch.setattr(references, "WIDE", wide)
    elements = random_world(3)
    inside = lambda x, y: box[0] <= x <= box[2] and box[1] <= y <= box[3]
    df = frame(spark, elements).repartition(5)
    assert references.is_wide(regions.from_box(box)) == (wide == 0)
    assert set(features(df, region=regions.from_box(box))) == expected(elements, inside=inside)
    assert set(features(df, flat={"building": True, "type": True}, region=regions.from_box(box))) == expected(elements, lambda t: "building" in t or "type" in t, inside)
