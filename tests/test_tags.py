"""The tag-filter language."""

from __future__ import annotations

import warnings

import pytest
from pyspark.sql import functions as F

from geoloom.errors import EmptyFilterWarning
from geoloom.functions import tags


@pytest.mark.parametrize(("given", "merged"), [
    ({"building": True}, {"building": True}),
    ({"amenity": "bank"}, {"amenity": "bank"}),
    ({}, {}),
    ({"money": {}}, {}),
    ({"money": {"amenity": "bank"}}, {"amenity": ["bank"]}),
    ({"money": {"amenity": "bank", "shop": "pawn"}, "food": {"amenity": ["cafe", "bank"]}}, {"amenity": ["bank", "cafe"], "shop": ["pawn"]}),
    ({"any": {"shop": True}, "some": {"shop": ["tea", "wine"], "name:*": True}}, {"shop": True, "name:*": True}),
    ({"not": {"access": False}, "roads": {"highway": ["path"]}}, {"access": False, "highway": ["path"]}),
    ([{"water": "lake"}, {"wet": {"water": "pond"}}], {"water": ["lake", "pond"]}),
])
def test_merge(given, merged):
    assert tags.merge_filter(given) == merged


@pytest.mark.parametrize("given", [{"g": {"a": True}, "h": {"a": False}}, {"g": {"a": False}, "h": {"a": "x"}}, [{"a": ["x"]}, {"a": False}]])
def test_conflict(given):
    with pytest.raises(ValueError):
        tags.merge_filter(given)


@pytest.mark.parametrize("given", [{"a": 1}, "a", {"a": [1]}, [{"a": None}], 5])
def test_not_a_filter(given):
    with pytest.raises(TypeError):
        tags.merge_filter(given)


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, {"building": "yes", "name:en": "a", "maxspeed": "50"}), (2, {"highway": "primary"}), (3, {"highway": "secondary", "name:de": "b"}), (4, {}), (5, None),
        (6, {"maxspeed": "55", "odd\\key": "x\\y", "Name": "z"}),
    ]
    return spark.createDataFrame(data, "id long, tags map<string,string>")


def ids(rows, flat):
    return sorted(r.id for r in rows.filter(tags.filter_column(tags.merge_filter(tags.expand_filter(rows, flat)))).collect())


@pytest.mark.parametrize(("flat", "expected"), [
    ({"building": True}, [1]), ({"building": False}, [2, 3, 4, 5, 6]), ({"highway": "primary"}, [2]), ({"highway": ["primary", "secondary"]}, [2, 3]),
    ({"highway": "*ary"}, [2, 3]), ({"highway": "**ary"}, [2, 3]), ({"name:*": True}, [1, 3]), ({"*speed": "*0"}, [1]), ({"*speed": ["*0", "55"]}, [1, 6]),
    ({"highway": True, "name:de": False}, [2]), ({"odd\\key": "x\\*"}, [6]), ({"highway": []}, []), ({"maxspeed": "5_"}, []), ({"maxspeed": "5_*"}, [1, 6]),
    ({"g": {"highway": "primary"}, "h": {"building": True}}, [1, 2]), ({"*": False}, [4, 5]),
])
def test_filter(rows, flat, expected):
    assert ids(rows, flat) == expected


@pytest.mark.parametrize("flat", [{"name:*": True, "name:en": False}, {"*speed": "*0", "maxspeed": False}, {"g": {"building": "*"}, "h": {"building": False}}])
def test_conflict_after_expansion(rows, flat):
    with pytest.raises(ValueError):
        tags.merge_filter(tags.expand_filter(rows, flat))


@pytest.mark.parametrize("flat", [{"nothing*": True}, {"g": {}}])
def test_empty_filter_warns_and_matches_nothing(rows, flat):
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert ids(rows, flat) == []
    assert any(w.category is EmptyFilterWarning for w in seen)


def test_expansion_is_sorted_without_case(rows):
    assert list(tags.expand_filter(rows, {"*a*": True})) == ["highway", "maxspeed", "Name", "name:de", "name:en"]


def test_strip_metadata(spark):
    row = spark.createDataFrame([({"area": "yes", "a": "b", "openGeoDB:x": "1", "source:x": "2", "FIXME": "c"},)], "tags map<string,string>")
    assert row.select(tags.strip_metadata("tags").alias("t")).first().t == {"a": "b", "source:x": "2"}


def features(rows):
    return rows.select(F.col("id").cast("string").alias("feature_id"), "tags", F.lit(None).cast("binary").alias("geometry"))


@pytest.mark.parametrize(("flat", "keep_all", "explode", "columns"), [
    (None, False, None, ["tags"]), (None, False, True, ["Name", "building", "highway", "maxspeed", "name:de", "name:en", "odd\\key"]),
    ({"highway": False}, False, None, ["tags"]), ({"highway": True, "building": "yes"}, False, None, ["highway", "building"]),
    ({"highway": True}, False, False, ["tags"]), ({"highway": True}, True, None, ["tags"]), ({"g": {"highway": True}, "f": {"building": True}}, False, None, ["f", "g"]),
    ({"g": {"highway": True}}, False, False, ["tags"]), ({"g": {"highway": True}}, True, None, ["tags"]),
])
def test_columns(spark, rows, flat, keep_all, explode, columns):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert tags.project_tags(features(rows), flat, keep_all, explode).columns == ["feature_id", *columns, "geometry"]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_values_of_projections(rows):
    one = lambda flat, **k: {r.feature_id: r for r in tags.project_tags(features(rows), flat, **k).collect()}
    assert one({"highway": "primary", "maxspeed": "*0"}, explode=False)["1"].tags == {"maxspeed": "50"}
    assert one({"highway": "primary"})["3"].highway is None
    grouped = {"roads": {"maxspeed": True, "highway": True}, "none": {"x": False}}
    assert one(grouped)["2"].roads == "highway=primary" and one(grouped)["2"].none is None
    assert one(grouped, explode=False)["1"].tags == {"roads": "maxspeed=50"}


def test_null_columns_are_dropped(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", None, None)], "feature_id string, `a``b` string, c int")
    assert tags.drop_null_columns(df).columns == ["feature_id", "c"]


def test_element_ids(spark):
    df = spark.createDataFrame([("node", 5), ("way", 5), ("relation", 6)], "kind string, id long")
    assert [tuple(r) for r in df.filter(tags.elements_with_ids(["way/5", "relation/7"])).collect()] == [("way", 5)]
    assert df.filter(tags.elements_with_ids([])).count() == 0
    with pytest.raises(ValueError):
        tags.elements_with_ids(["way5"])
