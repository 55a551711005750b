"""Schemas and fixed values of the OpenStreetMap model."""

from __future__ import annotations

from pyspark.sql import types as T

#: A raw element: one row for each node, way or relation.
ELEMENT = T.StructType([
    T.StructField("kind", T.StringType(), False),
    T.StructField("id", T.LongType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("refs", T.ArrayType(T.LongType())),
    T.StructField("lat", T.DoubleType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("ref_roles", T.ArrayType(T.StringType())),
    T.StructField("ref_types", T.ArrayType(T.StringType())),
])

#: A feature with its tags in one map; geometry is WKB.
FEATURE = T.StructType([
    T.StructField("feature_id", T.StringType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("geometry", T.BinaryType()),
])

POINTS = "array<struct<x:double,y:double>>"
FEATURE_ID, GEOMETRY, WGS84 = "feature_id", "geometry", "EPSG:4326"

#: Decimal places of coordinates.
PLACES = 7

#: Keys of metadata tags, and the prefix of another family of them.
METADATA_KEYS = ("area", "created_by", "converted_by", "source", "time", "ele", "note", "todo", "fixme", "FIXME")
METADATA_PREFIX = "openGeoDB:"

#: Which tags make a closed way an area. Any value of these keys does,
AREA_KEYS = (
    "allotments", "area:highway", "boundary", "bridge:support", "building:part", "building", "cemetery", "club", "craft",
    "demolished:building", "disused:amenity", "disused:leisure", "disused:shop", "healthcare", "historic", "industrial",
    "internet_access", "junction", "landuse", "leisure", "office", "place", "police", "polling_station", "public_transport",
    "residential", "ruins", "seamark:type", "shop", "sport", "telecom", "tourism",
)
#: these values of these keys do,
AREA_VALUES = {
    "advertising": ("sculpture", "sign"),
    "aerialway": ("station",),
    "barrier": ("city_wall", "hedge", "wall", "toll_booth"),
    "highway": ("services", "rest_area", "platform"),
    "railway": ("station", "turntable", "roundhouse", "platform"),
    "waterway": ("riverbank", "dock", "boatyard", "dam", "fuel"),
}
#: and all values but these of these keys do.
LINE_VALUES = {
    "aeroway": ("jet_bridge", "parking_position", "taxiway", "no"),
    "amenity": ("bench", "weighbridge"),
    "attraction": ("river_rafting", "train", "water_slide", "boat_ride"),
    "emergency": ("designated", "destination", "no", "official", "private", "yes"),
    "geological": ("volcanic_caldera_rim", "fault"),
    "golf": ("cartpath", "hole", "path"),
    "indoor": ("corridor", "wall"),
    "man_made": ("yes", "breakwater", "carpet_hanger", "crane", "cutline", "dyke", "embankment", "goods_conveyor", "groyne", "pier", "pipeline", "torii", "video_wall"),
    "military": ("trench",),
    "natural": ("bay", "cliff", "coastline", "ridge", "strait", "tree_row", "valley", "no", "arete"),
    "piste:type": ("downhill", "hike", "ice_skate", "nordic", "skitour", "sled", "sleigh"),
    "playground": ("balancebeam", "rope_traverse", "stepping_stone", "stepping_post", "rope_swing", "climbing_slope"),
    "power": ("cable", "line", "minor_line", "insulator", "busbar", "bay", "portal"),
}
#: Values of a relation's ``type`` tag that make it an area.
RELATION_TYPES = ("boundary", "multipolygon")
