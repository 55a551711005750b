"""The hand-made world, as rows and as a PBF file."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pbf_writer import packed as packed_bytes
from pbf_writer import write_pbf
from world import EXPECTED, node, relation, square, way, world

from geoloom.functions import region as regions
from geoloom.functions.wkb import to_wkt
from geoloom.plans.features import all_features, relation_parts
from geoloom.plans.references import resolve
from geoloom.schema import ELEMENT
from geoloom.sources.pbf import PbfReader, _packed_of, _running, packed, read_pbf, signed


def frame(spark, elements):
    return spark.createDataFrame([tuple(e.get(f.name) for f in ELEMENT) for e in elements], ELEMENT)


def features(elements, **options):
    return {r.feature_id: to_wkt(bytes(r.geometry)) for r in all_features(resolve(elements, **options)).collect()}


@pytest.fixture(scope="module")
def everything(spark):
    return features(frame(spark, world()))


def test_each_rule(everything):
    assert {k: v.split(" ")[0] for k, v in everything.items()} == {k: v.split(" ")[0] for k, v in EXPECTED.items()}


def test_geometry(everything):
    assert everything["node/1"] == "POINT (1 1)"
    assert everything["way/10"] == "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
    assert everything["relation/30"] == "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))"
    assert everything["relation/35"].count("((") == 2


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("compress", [True, False])
def test_pbf_gives_the_same(spark, everything, tmp_path, dense, compress):
    path = str(tmp_path / "world.osm.pbf")
    write_pbf(path, [e for e in world() if e["kind"] != "node" or e["lat"] is not None], dense=dense, compress=compress)
    assert features(read_pbf(spark, path)) == everything


def test_pbf_partitions_and_kinds(spark, tmp_path):
    path = str(tmp_path / "many.osm.pbf")
    many = [node(k, k / 1000, -k / 1000, **({"k": str(k)} if k % 3 == 0 else {})) for k in range(1, 200)] + [way(k, [1, 2, 3], a="b") for k in range(1, 30)]
    write_pbf(path, many, per_block=10)
    df = spark.read.format("osmpbf").option("path", path).option("partitionBytes", 200).load() if read_pbf(spark, path) else None
    assert df.rdd.getNumPartitions() > 3
    assert {(r.kind, r.id, r.lat, r.lon, tuple((r.tags or {}).items())) for r in df.filter("kind = 'node'").collect()} == {("node", e["id"], e["lat"], e["lon"], tuple((e["tags"] or {}).items())) for e in many if e["kind"] == "node"}
    assert read_pbf(spark, path, ("way",)).count() == 29


@pytest.mark.parametrize("compress", [True, False])
def test_each_blob_is_in_one_range(tmp_path, compress):
    """Ranges of any size, in files whose tags look like headers of blobs themselves."""
    path = str(tmp_path / "many.osm.pbf")
    like = ["OSMData", "\x00\x00\x00\x0b\x0a\x07OSMData\x18\x05", "x" * 300]
    many = [node(k, k / 1000, -k / 1000, **{"k": like[k % 3], "OSMData": str(k)}) for k in range(1, 60)] + [way(k, [k, 3, 900 * k], a="OSMData") for k in range(1, 30)]
    write_pbf(path, many, per_block=7, compress=compress)
    size = os.path.getsize(path)
    for step in [1, 3, 17, 64, 100, 333, 1000, size - 1, size, 10 * size]:
        reader = PbfReader([path], step, frozenset(("node", "way")))
        parts = reader.partitions()
        assert (parts[0].start, parts[-1].stop) == (0, size) and all(a.stop == b.start for a, b in zip(parts, parts[1:]))
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert [(r["kind"], r["id"], r["refs"]) for r in rows] == [(e["kind"], e["id"], e.get("refs")) for e in many]


@pytest.mark.parametrize("step", [50, 400, 1 << 20])
def test_a_file_that_ends_early_is_an_error(tmp_path, step):
    path = tmp_path / "cut.osm.pbf"
    write_pbf(path, [node(k, k / 1000, 0, k=str(k)) for k in range(1, 60)], per_block=9)
    whole = path.read_bytes()
    for cut in (2, 30, len(whole) // 2):
        path.write_bytes(whole[:-cut])
        reader = PbfReader([str(path)], step, frozenset(("node",)))
        with pytest.raises(ValueError, match="within"):
            for p in reader.partitions():
                list(reader.read(p))


def test_lists_of_a_group_are_decoded_together():
    rows = [{8: packed_bytes([0, 300])}, {}, {8: packed_bytes([5])}, {8: packed_bytes([2, 1, 2])}]
    values, sizes = _packed_of(rows, 8)
    assert (values.tolist(), sizes.tolist()) == ([0, 300, 5, 2, 1, 2], [2, 0, 1, 3])
    assert _running(np.array([1, 2, 5, -3, 1, 1]), sizes).tolist() == [1, 3, 5, -3, -2, -1]
    assert _packed_of([{}, {}], 8)[1].tolist() == [0, 0] and _running(np.zeros(0, np.int64), np.array([0, 0])).tolist() == []


def test_varints():
    assert packed(memoryview(bytes([1, 0x96, 0x01, 0xFF, 0xFF, 0x03]))).tolist() == [1, 150, 65535]
    assert signed(packed(memoryview(bytes([0, 1, 2, 3])))).tolist() == [0, -1, 1, -2]


def test_region_keeps_whole_ways_and_loses_crossing_ones(spark, everything):
    inside = features(frame(spark, world()), region=regions.from_box((-1, -1, 5, 5)))
    assert set(everything) - set(inside) == {"way/19"}
    assert inside["way/21"] == everything["way/21"]
    # way 21 runs from (0, 0) to (20, 20) through this box, without a vertex in it
    assert features(frame(spark, world()), region=regions.from_box((8, 8, 12, 12))) == {}


def test_filters(spark):
    e = frame(spark, world())
    assert set(features(e, flat={"building": True})) == {"way/10", "way/11", "way/18"}
    assert set(features(e, sql="tags['natural'] like 'w%'")) == {"way/15"}
    assert set(features(e, ids=["relation/30", "way/12"])) == {"relation/30", "way/12"}
    # the filter sees raw tags, SQL and the result do not
    assert set(features(e, flat={"area": "no"})) == {"way/11"}
    assert features(e, sql="tags['area'] = 'no'") == {}
    assert features(e, flat={"area": "yes"}) == {}
    assert set(features(e, flat={"created_by": True}, strip=False)) == {"node/2"}


def test_duplicate_relation_members_and_deep_sewing(spark):
    nodes, ring = square(1, 0, 0, 8)
    inner, hole = square(11, 2, 2, 2)
    touching, hole2 = square(21, 4, 4, 2)
    ways = [way(1, ring[:3]), way(2, ring[2:]), way(3, hole), way(4, hole2)]
    r = relation(9, [(2, "outer"), (3, "inner"), (1, "outer"), (4, "inner")], type="multipolygon", landuse="x")
    found = features(frame(spark, nodes + inner + touching + ways + [r]))
    assert found["relation/9"].startswith("POLYGON") and found["relation/9"].count("(") == 4


def test_overlapping_outer_rings_unite(spark):
    a, one = square(1, 0, 0, 4)
    b, two = square(11, 2, 2, 4)
    r = relation(9, [(1, "outer"), (2, "outer")], type="boundary", name="x")
    found = features(frame(spark, a + b + [way(1, one), way(2, two), r]))
    assert found["relation/9"].startswith("POLYGON ((") and found["relation/9"].count(",") == 8


def test_self_crossing_way_is_repaired(spark):
    nodes = [node(1, 0, 0), node(2, 2, 2), node(3, 2, 0), node(4, 0, 2)]
    found = features(frame(spark, nodes + [way(1, [1, 2, 3, 4, 1], building="yes")]))
    assert found["way/1"].startswith("MULTIPOLYGON")


def test_relation_parts():
    square_line = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    assert relation_parts([("outer", square_line), ("label", [(5, 5), (6, 6), (7, 7)])])[0] == [square_line]
    assert relation_parts([("outer", square_line), ("label", [(5, 5), (6, 6), (7, 7), (8, 8)])]) is None
    assert relation_parts([("inner", square_line)]) == ([square_line], [])
