"""Regions, rings, WKB and spatial order."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.errors import InvalidGeometryFilter
from geoloom.functions import arrays, topology, wkb
from geoloom.functions import region as regions
from geoloom.operators import ordering


def test_boxes_and_geohashes():
    assert regions.from_box("0,1,2,3") == [[[(0, 1), (2, 1), (2, 3), (0, 3), (0, 1)]]]
    a, b, c, d = regions.geohash_box("spv2bc")
    assert a <= 7.42 <= c and b <= 43.735 <= d and len(regions.from_geohash("spv2bc,spv2bfr")) == 2
    for bad in ("a", "1,2,3", "x,y,z,w"):
        with pytest.raises(ValueError):
            regions.from_box(bad)
    with pytest.raises(ValueError):
        regions.from_geohash("ail")


@pytest.mark.parametrize("text", ["POINT (1 1)", "LINESTRING (0 0, 1 1)", "MULTIPOINT ((0 0))", "POLYGON EMPTY", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "GEOMETRYCOLLECTION (POLYGON ((0 0, 1 0, 1 1, 0 0)), POINT (3 3))"])
def test_regions_need_area(text):
    with pytest.raises(InvalidGeometryFilter):
        regions.check_region(regions.from_wkt(text))


def test_normal_form_and_hash():
    one = regions.from_wkt("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))")
    two = regions.from_wkt("POLYGON ((4 4, 4 0, 0 0, 0 4, 4 4), (2 2, 2 1, 1 1, 1 2, 2 2))")
    assert regions.region_hash(one) == regions.region_hash(two) != regions.region_hash(regions.from_box((0, 0, 4, 4)))
    assert regions.region_hash(None) == "noclip"
    many = regions.from_geojson({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}] * 2})
    assert len(many) == 2


def test_geodesic_area():
    assert regions.geodesic_area_km2(regions.from_box((0, 0, 1, 1))) == pytest.approx(12308.8, rel=0.01)
    assert regions.geodesic_area_km2(regions.from_box((-180, -90, 180, 90))) == pytest.approx(510065622, rel=1e-4)


def test_points_against_brute_force(spark):
    rng = np.random.default_rng(3)
    ring = [(0.0, 0.0), (6.0, 1.0), (7.0, 5.0), (3.0, 3.0), (1.0, 6.0), (0.0, 0.0)]
    hole = [(2.0, 1.0), (3.0, 1.0), (3.0, 2.0), (2.0, 1.0)]
    x, y = rng.integers(-2, 20, 400) / 2, rng.integers(-2, 20, 400) / 2

    def winding(px, py, r):
        return sum((a[1] > py) != (b[1] > py) and px < (b[0] - a[0]) * (py - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(r, r[1:])) % 2 == 1

    def border(px, py, r):
        return any((b[0] - a[0]) * (py - a[1]) == (b[1] - a[1]) * (px - a[0]) and min(a[0], b[0]) <= px <= max(a[0], b[0]) and min(a[1], b[1]) <= py <= max(a[1], b[1]) for a, b in zip(r, r[1:]))

    truth = [border(p, q, ring) or border(p, q, hole) or (winding(p, q, ring) and not winding(p, q, hole)) for p, q in zip(x, y)]
    assert regions.contains([[ring, hole]], x, y).tolist() == truth
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").coalesce(1)
    assert [r[0] for r in df.select(arrays.in_rings(F.col("x"), F.col("y"), [ring, hole])).collect()] == truth


@given(st.integers(3, 40), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_sewing_restores_a_ring(n, seed):
    rng = random.Random(seed)
    ring = [(float(k), float((k * 7) % n)) for k in range(n)]
    ring.append(ring[0])
    cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6))))
    lines = [ring[a : b + 1] for a, b in zip([0, *cuts], [*cuts, n])]
    lines = [w[::-1] if rng.random() < 0.5 else w for w in lines]
    rng.shuffle(lines)
    (found,) = topology.sew(lines)
    assert found[0] == found[-1] and set(found) == set(ring) and len(found) == len(ring)


def test_sewing_stops_where_three_ends_meet():
    lines = [[(0, 0), (1, 0)], [(1, 0), (2, 0)], [(1, 0), (1, 1)]]
    assert sorted(map(len, topology.sew(lines))) == [2, 2, 2]


def test_ring_relations():
    outer = [(0, 0), (8, 0), (8, 8), (0, 8), (0, 0)]
    assert topology.ring_within([(1, 1), (2, 1), (2, 2), (1, 1)], outer)
    assert not topology.ring_within([(7, 7), (9, 7), (9, 9), (7, 7)], outer)
    assert not topology.ring_within([(10, 10), (11, 10), (11, 11), (10, 10)], outer)
    assert topology.polygons([outer], [[(20, 20), (21, 20), (21, 21), (20, 20)]]) == [[outer]]


@pytest.mark.parametrize("text", ["POINT (1.5 -2)", "LINESTRING (0 0, 1 1)", "POLYGON ((0 0, 4 0, 4 4, 0 0), (1 0.5, 2 0.5, 2 1, 1 0.5))"])
def test_wkb_round_trip(text):
    if text.startswith("POINT"):
        data = wkb.encode_points(np.array([1.5]), np.array([-2.0]))[0]
    elif text.startswith("LINE"):
        data = wkb.encode_line(np.array([(0, 0), (1, 1)], float))
    else:
        data = wkb.encode_polygon(regions.from_wkt(text)[0])
    assert wkb.to_wkt(data) == text


def test_array_functions(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 0.0)]
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in ring],), ([{"x": 1.0, "y": 1.0}],), ([],)], "p array<struct<x:double,y:double>>").coalesce(1)
    p = F.col("p")
    rows = df.select(F.size(arrays.without_repeats(p)), arrays.is_closed(p), arrays.is_ring(p), arrays.signed_area(p), arrays.line_wkt(p)).collect()
    assert tuple(rows[0]) == (4, True, True, 6.0, "LINESTRING (0 0, 4 0, 4 0, 4 3, 0 0)")
    assert tuple(rows[1])[:4] == (1, True, False, 0.0) and tuple(rows[2])[:4] == (0, False, False, 0.0)


def test_hilbert_visits_neighbours(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = sorted((r.d, r.x, r.y) for r in df.select("x", "y", ordering.hilbert_key(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [r[0] for r in rows] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:]))


@pytest.mark.parametrize("order", [ordering.sort_by_hilbert, ordering.sort_by_tiles])
def test_sorting_keeps_rows(spark, order):
    df = spark.range(500).select(F.rand(1).alias("x"), F.rand(2).alias("y"), "id")
    assert sorted(r.id for r in order(df, "x", "y").collect()) == list(range(500))
    assert order(df.limit(0), "x", "y").count() == 0
