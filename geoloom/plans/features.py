"""Features from a bundle: nodes to points, ways to lines and areas, relations to areas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions import batches, jts, topology
from geoloom.functions.arrays import area_tags, is_ring
from geoloom.functions.wkb import encode_polygons, points_wkb, ways_wkb
from geoloom.plans.references import Bundle
from geoloom.schema import AREA_KEYS, AREA_VALUES, LINE_VALUES, PLACES


def feature_id(kind: str, id_: Column | str = "id") -> Column:
    return F.concat(F.lit(f"{kind}/"), (F.col(id_) if isinstance(id_, str) else id_).cast("string"))


def node_features(bundle: Bundle) -> DataFrame:
    return bundle.nodes.select(feature_id("node").alias("feature_id"), "tags", points_wkb(F.round("lon", PLACES), F.round("lat", PLACES)).alias("geometry"))


def is_area(config: dict | None = None) -> Column:
    """Whether a way (raw_tags, points) is a polygon rather than a line."""
    c = config or {"all": AREA_KEYS, "allowlist": AREA_VALUES, "denylist": LINE_VALUES}
    return is_ring(F.col("points")) & area_tags(F.col("raw_tags"), tuple(c["all"]), c["allowlist"], c["denylist"])


def way_features(bundle: Bundle, config: dict | None = None) -> DataFrame:
    spark = bundle.ways.sparkSession
    if jts.install(spark):
        shape = jts.way(F.col("points"), is_area(config))
    else:
        batches.bound(spark)
        shape = ways_wkb(F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"]), is_area(config))
    return bundle.ways.select(feature_id("way").alias("feature_id"), "tags", shape.alias("geometry"))


def relation_parts(members: list[tuple[str | None, topology.Line]]) -> tuple[list[topology.Line], list[topology.Line]] | None:
    """(outer rings, inner rings) of a relation's members; None if a part of four points or more doesn't close.

    Members without a role are outer; if none is outer, all are. Lines are joined within each role; shorter parts vanish
    beforehand; parts of other roles count for the closing test only.
    """
    by: dict[str, list[topology.Line]] = {}
    for role, line in members:
        by.setdefault(role or "outer", []).append(line)
    if "outer" not in by:
        parts = [("outer", p) for v in by.values() for p in topology.sew(v)]
    else:
        parts = [(r, p) for r, v in by.items() for p in topology.sew(v)]
    parts = [(r, p) for r, p in parts if len(p) >= 4]
    if any(p[0] != p[-1] for _, p in parts):
        return None
    return [p for r, p in parts if r == "outer"], [p for r, p in parts if r == "inner"]


def _nested(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without JTS: rings nested as they are."""
    for b in rows:
        ids, out = [], []
        for key, members in zip(b.column("id").to_pylist(), b.column("members").to_pylist()):
            found = relation_parts([(m["role"] or None, [(p["x"], p["y"]) for p in m["points"]]) for m in sorted(members, key=lambda m: m["idx"])])
            shapes = topology.polygons(*found) if found else []
            if shapes:
                ids.append(key)
                out.append(encode_polygons(shapes))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["id", "geometry"])


def relation_geometry(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(id, geometry) of the relations that have all their ways, one of them inside if ``ways`` has ``hit``, and whose parts close.

    One join and one aggregation: a relation's members are listed and found complete together.
    """
    spark = members.sparkSession
    hit = F.col("hit") if "hit" in ways.columns else F.lit(True)
    rows = members.join(ways.select(F.col("id").alias("ref"), "points", hit.alias("hit")), "ref", "left")
    row = F.struct(F.col("ref_idx").cast("int").alias("idx"), F.col("ref_role").alias("role"), "points")
    whole = rows.groupBy("id").agg(F.collect_list(row).alias("members"), F.count_if(F.col("points").isNull()).alias("missing"), F.count_if("hit").alias("hits")).filter("missing = 0 and hits > 0")
    if jts.install(spark):
        # a filter on the shape would be pushed below it and make each shape twice
        made = F.filter(F.array(jts.area(F.col("members"))), lambda g: g.isNotNull())
        return whole.select("id", F.explode(made).alias("geometry"))
    batches.bound(spark)
    return whole.select("id", "members").mapInArrow(_nested, "id long, geometry binary")


def relation_features(bundle: Bundle) -> DataFrame:
    shapes = relation_geometry(bundle.members, bundle.member_ways)
    return bundle.relations.join(shapes, "id").select(feature_id("relation").alias("feature_id"), "tags", "geometry")


def all_features(bundle: Bundle, config: dict | None = None) -> DataFrame:
    """(feature_id, tags, geometry) of all kinds."""
    return node_features(bundle).unionByName(way_features(bundle, config)).unionByName(relation_features(bundle))
