"""Indexes of extracts, search by name and cover of regions."""

from __future__ import annotations

import json
import os
import time
import warnings

import pytest

from geoloom.errors import GeometryNotCoveredError, OldOsmCacheWarning, OsmExtractMultipleMatchesError, OsmExtractsUnavailableError, OsmExtractZeroMatchesError
from geoloom.functions import region as regions
from geoloom.functions.jts import DriverGeometry
from geoloom.operators import extracts as search
from geoloom.sources import extracts as sources
from geoloom.sources.extracts import Extract, Source


def box(*b):
    return {"type": "Polygon", "coordinates": [[list(p) for p in regions.from_box(b)[0][0]]]}


def make(id_, name, b, parent="src"):
    return Extract(id_, name, parent, f"http://x/{id_}.osm.pbf", regions.from_box(b))


@pytest.fixture(scope="module")
def index():
    return sources.finished([
        make("world", "World", (-50, -50, 50, 50)), make("west", "West", (-50, -50, 0, 50), "world"), make("east", "East", (0, -50, 50, 50), "world"),
        make("small", "Small town", (1, 1, 3, 3), "east"), make("t1", "Twin", (10, 10, 12, 12), "east"), make("t2", "Twin", (-12, 10, -9, 13), "west"),
    ])


def test_sources():
    assert sources.resolve_sources("bbbike,OSMFR") == [Source.bbbike, Source.osm_fr]
    assert len(sources.resolve_sources("any")) == 6 and sources.resolve_sources(["geofabrik", Source.bbbike, "GEOFABRIK"]) == [Source.geofabrik, Source.bbbike]
    for bad in ("", [], "nowhere"):
        with pytest.raises(ValueError):
            sources.resolve_sources(bad)


def test_full_names(index):
    assert {e.id: e.file_name for e in index}["small"] == "src_world_east_small_town"
    assert [e.area for e in index] == sorted(e.area for e in index)
    assert sources.slug("Île-de France!") == "ile-de_france"


def test_by_name(index):
    assert search.by_name(index, "small_town").id == "small"
    assert search.by_name(index, "src_world_west").id == "west"
    with pytest.raises(OsmExtractMultipleMatchesError) as e:
        search.by_name(index, "twin", first=False)
    assert len(e.value.matching_full_names) == 2
    with pytest.warns(UserWarning.__mro__[1]):
        assert search.by_name(index, "twin").id == "t1"
    with pytest.raises(OsmExtractZeroMatchesError) as e:
        search.by_name(index, "smal town")
    assert e.value.matching_full_names == ["src_world_east_small_town"]
    with pytest.raises(OsmExtractZeroMatchesError) as e:
        search.by_name(index, "qqqqqq")
    assert e.value.matching_full_names == []


def test_retry_by_name(index):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert search.available_by_name(index, "Twin", lambda e: None if e.id == "t1" else e.id) == "t2"
        with pytest.raises(OsmExtractsUnavailableError):
            search.available_by_name(index, "East", lambda e: None)


@pytest.fixture(scope="module")
def geometry(spark):
    return DriverGeometry(spark)


def names(found):
    return [e.id for e in found]


def test_cover(index, geometry):
    assert names(search.smallest_cover(geometry, index, regions.from_box((1.5, 1.5, 2.5, 2.5)))) == ["small"]
    assert names(search.smallest_cover(geometry, index, regions.from_box((-50, -50, 0, 50)))) == ["west"]
    assert set(names(search.smallest_cover(geometry, index[:-1], regions.from_box((-40, -40, 40, 40)), 0))) == {"west", "east"}
    assert names(search.smallest_cover(geometry, index, regions.from_box((-12, 10, -9, 13)) + regions.from_box((10, 10, 12, 12)))) == ["t2", "t1"]
    with pytest.raises(ValueError):
        search.smallest_cover(geometry, index, regions.from_box((0, 0, 1, 1)), 1.5)
    with pytest.raises(GeometryNotCoveredError):
        search.smallest_cover(geometry, index, regions.from_box((60, 60, 70, 70)))
    with pytest.warns(Warning):
        assert search.smallest_cover(geometry, index, regions.from_box((60, 60, 70, 70)), allow_uncovered=True) == []
    with pytest.raises(RuntimeError):
        search.smallest_cover(geometry, [], regions.from_box((0, 0, 1, 1)))


def test_cover_of_twins_keeps_one(geometry):
    twins = sources.finished([make("a", "A", (0, 0, 4, 4)), make("b", "B", (0, 0, 4, 4)), make("c", "C", (3, 0, 9, 4))])
    assert len(search._thinned(geometry, twins[:2], [regions.from_box((0, 0, 4, 4))])) == 1


def test_retry_of_cover(index, geometry):
    with pytest.warns(Warning):
        found = search.available_cover(geometry, index, regions.from_box((1.5, 1.5, 2.5, 2.5)), lambda e: None if e.id == "small" else e.id)
    assert [e.id for e, _ in found] == ["east"]


def test_poly():
    text = "name\n1\n 0 0\n 4 0\n 4 4\n 0 0\nEND\n!2\n 1 0.5\n 2 0.5\n 2 1\nEND\n3\n 9 9\n 10 9\n 10 10\n 9 9\nEND\nEND\n"
    shape = sources.parse_poly(text.splitlines())
    assert [len(p) for p in shape] == [2, 1] and shape[0][1][0] == shape[0][1][-1]


def test_geofabrik():
    data = {"features": [{"properties": {"id": i, "parent": p, "urls": {"pbf": "u"}}, "geometry": box(0, 0, 1, 1)} for i, p in (("europe", None), ("poland", "europe"), ("us/maine", "north-america"))]}
    found = {e.id: (e.name, e.parent) for e in sources.parse_geofabrik(data)}
    assert found == {"Geofabrik_europe": ("europe", "Geofabrik"), "Geofabrik_poland": ("poland", "Geofabrik_europe"), "Geofabrik_us/maine": ("us_maine", "Geofabrik_us")}


def test_movisda():
    data = {"features": [{"properties": {"prefix": f"{c}-", "name": c, "name_en": None}, "geometry": box(0, 0, 1, 1)} for c in ("RW", "RW-02", "XX-01")]}
    assert [e.parent for e in sources.parse_movisda(data, "b", Source.movisda_admin, True)] == ["Movisda-admin", "Movisda-admin_RW", "Movisda-admin"]
    grid = sources.parse_movisda(data, "b", Source.movisda_grid, False)
    assert {e.parent for e in grid} == {"Movisda-grid"} and grid[1].url == "b/RW-02-latest.osm.pbf" and grid[1].name == "RW-02"


def site(pages):
    return lambda url: pages.get(url)


def test_listings():
    poly = "n\n1\n 0 0\n 1 0\n 1 1\n 0 0\nEND\nEND"
    pages = {
        f"{sources.BBBIKE}/": '<table><tr class="d"><td><a href="../">..</a></td></tr><tr class="d"><td><a href="Ulm/">Ulm</a></td></tr><tr class="d"><td><a href="Bonn/">Bonn</a></td></tr></table>',
        f"{sources.BBBIKE}/Ulm/Ulm.poly": poly, sources.BBBIKE_CITIES: "Bonn:a:b:c:d:e:7 50 8 51:x",
        f"{sources.OSM_FR}/": '<table><tr><td><img src="/icons/folder.gif"></td><td><a href="europe/">europe/</a></td></tr><tr><td><a href="africa-latest.osm.pbf">africa</a></td></tr></table>',
        f"{sources.OSM_FR}/europe/": '<table><tr><td><a href="france-latest.osm.pbf">f</a></td></tr><tr><td><a href="lost-latest.osm.pbf">l</a></td></tr></table>',
        f"{sources.OSM_FR_POLYGONS}/africa.poly": poly, f"{sources.OSM_FR_POLYGONS}/europe/france.poly": poly,
        sources.GEO2DAY: '<a href="/europe.html">E</a><a href="/">home</a><a href="/europe/spain.html">no</a>',
        f"{sources.GEO2DAY}europe.html": '<a href="/europe.html">self</a><a href="europe/spain.html">S</a>', f"{sources.GEO2DAY}europe.geojson": json.dumps(box(0, 0, 9, 9)),
        f"{sources.GEO2DAY}europe/spain.geojson": json.dumps(box(1, 1, 2, 2)),
    }
    fetch = site(pages)
    assert [(e.id, regions.bounds(e.geometry)) for e in sources.bbbike(fetch)] == [("BBBike_Ulm", (0, 0, 1, 1)), ("BBBike_Bonn", (7, 50, 8, 51))]
    assert [(e.id, e.parent) for e in sources.osm_fr(fetch)] == [("osmfr_africa", "osmfr"), ("osmfr_europe_france", "osmfr_europe")]
    assert [(e.id, e.parent, e.url) for e in sources.geo2day(fetch)] == [("GEO2Day_europe", "GEO2Day", f"{sources.GEO2DAY}europe.pbf"), ("GEO2Day_europe_spain", "GEO2Day_europe", f"{sources.GEO2DAY}europe/spain.pbf")]


def test_cache(tmp_path):
    data = json.dumps({"features": [{"properties": {"id": "europe", "urls": {"pbf": "u"}}, "geometry": box(0, 0, 1, 1)}]})
    calls = []

    def fetch(url):
        calls.append(url)
        if url != sources.GEOFABRIK:
            raise OSError("away")
        return data

    with pytest.warns(Warning):
        first = sources.load_index(Source.geofabrik, tmp_path, fetch)
    assert sources.load_index(Source.geofabrik, tmp_path, fetch) == first and len(calls) == 1
    with pytest.warns(Warning):
        assert sources.load_indexes("geofabrik,osmfr", tmp_path, fetch) == first
    old = time.time() - 400 * 86400
    os.utime(tmp_path / "geofabrik_index.parquet", (old, old))
    with pytest.warns(OldOsmCacheWarning):
        assert sources.load_index(Source.geofabrik, tmp_path, fetch) == first
    sources.clear_cache(tmp_path)
    assert not list(tmp_path.glob("*.parquet"))


def test_tree(index):
    lines = sources.tree_lines([e for e in index if e.id != "west"], "src")
    assert lines[0] == "src" and lines[1].strip().startswith("World") and lines[2].startswith("    East") and lines[-1].strip().startswith("Twin")
    assert sources.human(1234567) == "1.23M" and sources.human(999) == "999" and sources.human(0.5) == "0.5" and sources.human(10) == "10"


def test_urls():
    assert sources.is_url("https://a/b") and sources.is_url("ftp://a") and not sources.is_url("/a/b") and not sources.is_url("c:/x")
