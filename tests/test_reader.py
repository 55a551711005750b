"""The reader, its results and the command line."""

from __future__ import annotations

import json
import sys
import types
from pathlib import Path

import duckdb
import pyarrow.parquet as pq
import pytest
from pbf_writer import write_pbf
from pyspark.sql import functions as F
from world import EXPECTED, world

from geoloom import reader, sink
from geoloom.cli import main, parse_ids
from geoloom.errors import EmptyFilterWarning, InvalidGeometryFilter
from geoloom.functions import region as regions
from geoloom.reader import OsmReader
from geoloom.sources import extracts as sources
from geoloom.sources import files


@pytest.fixture(scope="module")
def pbf(tmp_path_factory):
    path = tmp_path_factory.mktemp("pbf") / "world.osm.pbf"
    write_pbf(path, [e for e in world() if e["kind"] != "node" or e["lat"] is not None])
    return path


@pytest.mark.parametrize("single", [True, False])
@pytest.mark.parametrize("algorithm", ["str", "hilbert"])
def test_geoparquet(spark, pbf, tmp_path, single, algorithm):
    out = OsmReader(spark, working_directory=str(tmp_path)).pbf_to_parquet(pbf, algorithm=algorithm, single_file=single)
    assert Path(out).name == "world_nofilter_noclip_compact_sorted.parquet" and Path(out).is_file() == single
    files = [out] if single else sorted(Path(out).glob("*.parquet"))
    assert sum(pq.read_metadata(f).num_rows for f in files) == len(EXPECTED)
    geo = json.loads(pq.read_schema(files[0]).metadata[b"geo"])
    assert geo["columns"]["geometry"]["crs"]["id"]["code"] == "CRS84" and geo["creator"]["version"]
    assert geo["version"] == "1.1.0" and geo["columns"]["geometry"]["bbox"] == [0, 0, 22, 22] and "Polygon" in geo["columns"]["geometry"]["geometry_types"]
    assert set(spark.read.parquet(out).toPandas().feature_id) == set(EXPECTED)


def test_result_is_used_again(spark, pbf, tmp_path):
    r = OsmReader(spark, working_directory=str(tmp_path))
    out = r.pbf_to_parquet(pbf, sort=False, single_file=True)
    Path(out).write_text("kept")
    assert r.pbf_to_parquet(pbf, sort=False) == out and Path(out).read_text() == "kept"
    assert pq.read_metadata(r.pbf_to_parquet(pbf, sort=False, ignore_cache=True, single_file=True)).num_rows == len(EXPECTED)
    uri = f"file://{tmp_path}/store"
    r = OsmReader(spark, working_directory=uri)
    out = r.pbf_to_parquet(pbf, sort=False)
    assert out.startswith(uri) and spark.read.parquet(out).count() == len(EXPECTED) and r.pbf_to_parquet(pbf, sort=False) == out


def test_exploded_columns(spark, pbf):
    frame = OsmReader(spark, {"building": True, "shop": True}).read(pbf)
    assert frame.columns == ["feature_id", "building", "geometry"] and frame.count() == 3
    assert OsmReader(spark, {"b": {"building": True}, "n": {"natural": "wood"}}).read(pbf).columns == ["feature_id", "b", "n", "geometry"]
    assert OsmReader(spark, {"building": True}).pbf_to_pandas(pbf, keep_all_tags=True).loc["way/11"].tags == {"building": "yes"}


def test_switches(spark, pbf, tmp_path):
    """Ids of any kind, and a filter that merges to nothing: each by choice, and each under a name of its own."""
    loose = OsmReader(spark, working_directory=str(tmp_path), loose_ids=True)
    strict = OsmReader(spark, working_directory=str(tmp_path))
    found = lambda r, **options: {row.feature_id for row in r.read(pbf, **options).collect()}
    assert found(strict, ids=["relation/10", "node/11"]) == set()
    assert found(loose, ids=["relation/10", "node/11"]) == {k for k in EXPECTED if k.split("/")[1] in ("10", "11")} != set()
    names = {r._name(["a.osm.pbf"], None, False, None, i, False, False) for r in (loose, strict) for i in (None, ["way/10"])}
    assert len(names) == 3

    nothing = {"no such key*": True}
    with pytest.warns(EmptyFilterWarning):
        assert found(OsmReader(spark, nothing)) == set()
    kept = OsmReader(spark, nothing, empty_filter_keeps_all=True)
    assert found(kept) == set(EXPECTED)
    assert kept._name(["a"], None, False, None, None, False, False) != OsmReader(spark, nothing)._name(["a"], None, False, None, None, False, False)


def test_frames_have_geometries_where_the_library_is(spark, pbf, monkeypatch):
    """A stand-in for the library, which tests can't count on."""
    made = {}

    class Series:
        @staticmethod
        def from_wkb(values, crs):
            made["crs"], made["bytes"] = crs, all(isinstance(v, bytes) for v in values)
            return values

    library = types.ModuleType("geopandas")
    library.GeoSeries = Series
    library.GeoDataFrame = lambda frame, geometry: frame.assign(geometry=geometry)
    monkeypatch.setitem(sys.modules, "geopandas", library)
    frame = OsmReader(spark).pbf_to_pandas(pbf)
    assert made == {"crs": "EPSG:4326", "bytes": True} and set(frame.index) == set(EXPECTED)
    monkeypatch.setitem(sys.modules, "geopandas", None)
    assert set(OsmReader(spark).pbf_to_pandas(pbf).columns) == {"tags", "geometry"}


def test_wkt_table_and_duckdb(spark, pbf, tmp_path):
    r = OsmReader(spark, working_directory=str(tmp_path))
    with pytest.raises(ValueError):
        r.pbf_to_parquet(pbf, wkt=True)
    text = spark.read.parquet(r.pbf_to_parquet(pbf, sort=False, wkt=True)).filter("feature_id = 'node/1'").first()
    assert text.geometry == "POINT (1 1)"
    r.pbf_to_table(pbf, "world_features")
    assert spark.table("world_features").count() == len(EXPECTED)
    path = r.pbf_to_duckdb(pbf, table="t")
    with duckdb.connect(path) as c:
        assert c.sql("select count(*) from t").fetchall() == [(len(EXPECTED),)]


def test_several_files(spark, pbf, tmp_path):
    other = tmp_path / "other.osm.pbf"
    write_pbf(other, [e for e in world() if e["kind"] == "node" and e["lat"] is not None])
    frame = OsmReader(spark).read([other, pbf])
    assert sorted(r.feature_id for r in frame.select("feature_id").collect()) == sorted(EXPECTED)


def test_empty_result(spark, pbf, tmp_path):
    with pytest.warns(Warning):
        out = OsmReader(spark, {"nothing": True}, working_directory=str(tmp_path)).pbf_to_parquet(pbf, single_file=True)
        folder = OsmReader(spark, {"nothing": True}, working_directory=str(tmp_path)).pbf_to_parquet(pbf, result=str(tmp_path / "folder.parquet"))
    assert spark.read.parquet(folder).columns == ["feature_id", "geometry"] and spark.read.parquet(folder).count() == 0
    assert pq.read_schema(out).names == ["feature_id", "geometry"] and pq.read_metadata(out).num_rows == 0


def test_arguments(spark):
    for bad in ({"region": []}, {"region": regions.from_wkt("POLYGON ((0 0, 1 1, 0 0, 0 0))")}):
        with pytest.raises(InvalidGeometryFilter):
            OsmReader(spark, **bad)
    for bad in ({"parquet_version": "v3"}, {"min_iou": 2}, {"polygon_config": {"all": []}}):
        with pytest.raises(ValueError):
            OsmReader(spark, **bad)
    with pytest.raises(TypeError):
        OsmReader(spark, tags_filter={"a": 1})


def test_polygon_config(spark, pbf):
    frame = OsmReader(spark, {"building": True}, polygon_config={"all": [], "allowlist": {}, "denylist": {}}).read(pbf)
    from geoloom.functions.wkb import wkb_type

    assert {r[0] for r in frame.select(wkb_type("geometry")).collect()} == {"LineString"}


def test_names():
    assert sink.result_name(["a.osm.pbf", "b.osm.pbf"], wkt=True) == "a_b_nofilter_noclip_compact_wkt.parquet"
    with_all = sink.result_name(["a.osm.pbf"], {"a": True}, keep_all=True, explode=True, ids=["way/1"], ordered=True)
    assert with_all.startswith("a_") and "_alltags_noclip_exploded_" in with_all and with_all.endswith("_sorted.parquet")
    assert sink.result_name(None, region=regions.from_box((0, 0, 1, 1))).endswith("_nofilter_compact.parquet")


def hooks(pbf):
    data = {"features": [{"properties": {"id": "all", "urls": {"pbf": "http://x/all.osm.pbf"}}, "geometry": {"type": "Polygon", "coordinates": [[[-1, -1], [30, -1], [30, 30], [-1, 30], [-1, -1]]]}}]}
    return {"fetch": lambda url: json.dumps(data) if url == sources.GEOFABRIK else None, "fetch_bytes": lambda url: pbf.read_bytes()}


@pytest.mark.filterwarnings("ignore")
def test_regions_and_extracts(spark, pbf, tmp_path):
    options = {"working_directory": str(tmp_path), "extract_source": "geofabrik", **hooks(pbf)}
    out = reader.convert_region_to_parquet(spark, regions.from_box((-0.5, -0.5, 5, 5)), **options)
    assert spark.read.parquet(out).count() == len(EXPECTED) - 1
    assert pq.read_metadata(reader.convert_extract_to_parquet(spark, "all", single_file=True, **options)).num_rows == len(EXPECTED)
    assert len(reader.convert_region_to_pandas(spark, regions.from_box((-0.5, -0.5, 5, 5)), **options)) == len(EXPECTED) - 1
    with pytest.raises(AttributeError):
        OsmReader(spark).find_extracts()


@pytest.mark.filterwarnings("ignore")
def test_command_line(spark, pbf, tmp_path, capsys):
    work = ["--working-directory", str(tmp_path)]
    assert main([str(pbf), *work, "--osm-tags-filter", '{"building": true}', "--no-sort", "--single-file"], spark) == 0
    assert pq.read_metadata(capsys.readouterr().out.strip()).num_rows == 3
    assert main([str(pbf), *work, "--wkt-result", "--geom-filter-bbox=-1,-1,5,5", "--filter-osm-ids", "way/10,node/1"], spark) == 0
    assert spark.read.parquet(capsys.readouterr().out.strip()).count() == 2
    assert main([str(pbf), *work, "-o", str(tmp_path / "x.duckdb"), "--silent"], spark) == 0 and (tmp_path / "x.duckdb").exists()
    assert main([*work, "--osm-extract-query", "nowhere", "--osm-extract-source", "geofabrik"], spark, **hooks(pbf)) == 1
    assert main([*work, "--show-extracts", "--osm-extract-source", "geofabrik"], spark, **hooks(pbf)) == 0
    assert "all (" in capsys.readouterr().out


@pytest.mark.parametrize("argv", [
    [], ["x.osm.pbf", "--osm-tags-filter", "{"], ["x.osm.pbf", "--osm-tags-filter", '{"a": 1}'], ["x", "--geom-filter-bbox", "1,2"], ["x", "--geom-filter-wkt", "POINT (1 1)"],
    ["x", "--geom-filter-bbox=0,0,1,1", "--geom-filter-index-geohash", "u"], ["x", "--filter-osm-ids", "way5"], ["x", "--parquet-version", "v3"], ["x", "--iou-threshold", "2"],
    ["x", "--silent", "--transient"], ["x", "--geom-filter-index-h3", "8a3969a40ac7fff"],
])
def test_bad_arguments(argv):
    with pytest.raises(SystemExit):
        main(argv)


def test_files(tmp_path):
    one, two = str(tmp_path / "a" / "x.bin"), f"file://{tmp_path}/b/y.tar.gz"
    for path in (one, two):
        assert not files.exists(path) and files.size(path) == 0
        files.write(path, [b"ab", b"c"])
        assert files.exists(path) and files.size(path) == 3
    assert files.with_ending(two, ".z") == f"file://{tmp_path}/b/y.tar.z" and files.name_of(one) == "x.bin" and files.join("s3://b/c/", "d") == "s3://b/c/d"


def test_downloads_are_ordered_by_size(spark, pbf, tmp_path, monkeypatch):
    """Of a feature in two files the larger file's stays, also when both are URLs."""
    order = []
    monkeypatch.setattr(reader.OsmReader, "features", lambda self, e, *a, **k: e.select(F.concat(F.lit("node/"), "id").alias("feature_id")))
    monkeypatch.setattr(reader.OsmReader, "_elements", lambda self, path: order.append(files.size(path)) or spark.range(3))
    fetch = lambda url: b"x" * (10 if "small" in url else 1000)
    combined = []
    monkeypatch.setattr(reader.dedupe, "combine", lambda frames: combined.extend(frames) or frames[0])
    OsmReader(spark, working_directory=str(tmp_path), fetch_bytes=fetch).read(["http://a/small.osm.pbf", "http://a/large.osm.pbf"])
    assert order == [10, 1000] and len(combined) == 2


def test_ids():
    assert parse_ids("node/1, way/2") == ["node/1", "way/2"]


def test_stream_of_nodes(spark, tmp_path):
    from test_features import frame

    from geoloom.streaming.elements import node_feature_stream, read_elements

    frame(spark, world()).write.parquet(str(tmp_path / "in"))
    stream = node_feature_stream(read_elements(spark, str(tmp_path / "in")), {"amenity": True}, regions.from_box((0, 0, 2, 2)))
    q = stream.writeStream.format("memory").queryName("nodes").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert [r.feature_id for r in spark.table("nodes").collect()] == ["node/1"]


def test_package_exports():
    import geoloom

    assert all(callable(getattr(geoloom, name)) for name in geoloom.__all__)
    with pytest.raises(AttributeError):
        geoloom.nothing


def test_geocoding():
    from geoloom.cli import geocode
    from geoloom.errors import QueryNotGeocodedError

    answer = {"features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 1]}}, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}
    assert regions.bounds(geocode("x", lambda url: json.dumps(answer))) == (0, 0, 1, 1)
    with pytest.raises(QueryNotGeocodedError):
        geocode("x", lambda url: None)
