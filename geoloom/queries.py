"""Queries for each operator over the star-schema tables, with the same in SQL where SQL can express it.

Parts are nodes, orders ways, customers relations (:mod:`geoloom.plans.star`).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom import sink
from geoloom.functions import arrays, tags
from geoloom.functions import region as regions
from geoloom.functions.jts import DriverGeometry
from geoloom.functions.wkb import decode, wkb_to_wkt, wkb_type
from geoloom.operators import dedupe, ordering
from geoloom.operators import extracts as search
from geoloom.plans import features, references, star
from geoloom.plans.star import tags_text, tags_text_sql
from geoloom.sink import box_of
from geoloom.sources import extracts as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, base: bool = True):
    """Register a query under its function's name; its SQL goes after the elements' common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (star.SQL + sql) if base else sql
        return f

    return add


TEXT = tags_text_sql()
STRIPPED = "map_from_entries(list_filter(map_entries(tags), lambda e: e.key not in ('area','created_by','converted_by','source','time','ele','note','todo','fixme','FIXME') and not starts_with(e.key, 'openGeoDB:')))"
STRIPPED_TEXT = tags_text_sql(STRIPPED)
BOX = (-60.0, -30.0, 75.0, 60.0)
IN_BOX = "lon between -60 and 75 and lat between -30 and 60"
#: A convex region, counter-clockwise, and the same as half-planes.
RING = [(-100.0, -40.0), (80.0, -60.0), (140.0, 30.0), (0.0, 80.0), (-100.0, -40.0)]
IN_RING = " and ".join(f"(({b[0] - a[0]}) * (lat - ({a[1]})) - ({b[1] - a[1]}) * (lon - ({a[0]}))) >= 0" for a, b in zip(RING, RING[1:]))


# ---- scans and views


@query("select id, lat, lon from nodes where lat is not null and lon is not null")
def view_nodes(spark, d):
    return references.node_view(star.elements(spark, d)).select("id", "lat", "lon")


@query("select id, len(refs)::bigint as n_refs from ways where len(refs) >= 2")
def view_ways(spark, d):
    return references.way_view(star.elements(spark, d)).select("id", F.size("refs").cast("long").alias("n_refs"))


@query("select id, tags['boundary'] as boundary from relations where tags['type'] in ('boundary', 'multipolygon') and id in (select id from members)")
def view_relations(spark, d):
    return references.relation_view(star.elements(spark, d)).select("id", F.col("tags")["boundary"].alias("boundary"))


@query("select id, ref, ref_role, ref_idx::bigint as ref_idx from members join relations using (id) where tags['type'] = 'multipolygon'")
def unnest_members(spark, d):
    return references.member_refs(references.relation_view(star.elements(spark, d))).withColumn("ref_idx", F.col("ref_idx").cast("long"))


@query("select id, unnest(refs) as ref, (unnest(range(len(refs))))::bigint as ref_idx from ways where len(refs) >= 2")
def unnest_way_nodes(spark, d):
    return references.node_refs(references.way_view(star.elements(spark, d))).withColumn("ref_idx", F.col("ref_idx").cast("long"))


@query("select kind, count(*) as n from (select 'node' as kind from nodes union all select 'way' from ways union all select 'relation' from relations) group by kind")
def elements_by_kind(spark, d):
    return star.elements(spark, d).groupBy("kind").agg(F.count("*").alias("n"))


# ---- tag filters


def _filtered(spark, d, flat):
    ways = star.way_tags(spark, d)
    return ways.filter(tags.filter_column(tags.merge_filter(tags.expand_filter(ways, flat)))).select("id", tags_text().alias("tags"))


@query(f"select id, {TEXT} as tags from ways where list_contains(map_keys(tags), 'building')")
def filter_key_exists(spark, d):
    return _filtered(spark, d, {"building": True})


@query(f"select id, {TEXT} as tags from ways where not list_contains(map_keys(tags), 'highway')")
def filter_key_absent(spark, d):
    return _filtered(spark, d, {"highway": False})


@query(f"select id, {TEXT} as tags from ways where tags['natural'] = 'wood'")
def filter_value(spark, d):
    return _filtered(spark, d, {"natural": "wood"})


@query(f"select id, {TEXT} as tags from ways where tags['maxspeed'] in ('30', '50') or tags['natural'] in ('cliff')")
def filter_values(spark, d):
    return _filtered(spark, d, {"maxspeed": ["30", "50"], "natural": ["cliff"]})


@query(f"select id, {TEXT} as tags from ways where tags['highway'] like '%mary' or tags['maxspeed'] like '%0'")
def filter_value_wildcard(spark, d):
    return _filtered(spark, d, {"highway": "*mary", "maxspeed": "*0"})


@query(f"select id, {TEXT} as tags from ways where len(list_filter(map_keys(tags), lambda k: k like 'n%')) > 0 and not list_contains(map_keys(tags), 'maxspeed')")
def filter_key_wildcard(spark, d):
    return _filtered(spark, d, {"n*": True, "maxspeed": False})


@query(f"select id, {TEXT} as tags from ways where (tags['highway'] in ('primary', 'secondary') or list_contains(map_keys(tags), 'building')) and not list_contains(map_keys(tags), 'area')")
def filter_groups_merged(spark, d):
    return _filtered(spark, d, {"roads": {"highway": "primary", "area": False}, "other": {"highway": ["secondary"], "building": True}})


@query(f"select id, {TEXT} as tags from ways where tags is not null and cardinality(tags) > 0")
def filter_has_tags(spark, d):
    return star.way_tags(spark, d).filter(tags.has_tags()).select("id", tags_text().alias("tags"))


# ---- other predicates


@query(f"select id, {STRIPPED_TEXT} as tags from nodes where cardinality({STRIPPED}) = 3 and starts_with(tags['brand'], 'Brand')")
def filter_sql(spark, d):
    split = references.with_metadata_split(star.elements(spark, d).filter("kind = 'node'"))
    return split.filter(references.wanted(None, "cardinality(tags) = 3 and startswith(tags['brand'], 'Brand')")).select("id", tags_text().alias("tags"))


@query("select 'node' as kind, id from nodes where id in (1, 2) union all select 'way', id from ways where id in (3)")
def filter_ids(spark, d):
    return star.elements(spark, d).filter(tags.elements_with_ids(["node/1", "node/2", "way/3", "relation/999999999"])).select("kind", "id")


@query(f"select id, {STRIPPED_TEXT} as tags, {TEXT} as raw_tags from ways where cardinality({STRIPPED}) > 0")
def strip_metadata_tags(spark, d):
    return references.with_metadata_split(star.way_tags(spark, d)).filter(tags.has_tags()).select("id", tags_text().alias("tags"), tags_text("raw_tags").alias("raw_tags"))


@query(f"select id, lon, lat from nodes where {IN_BOX}")
def nodes_in_box(spark, d):
    return star.nodes(spark, d).filter(arrays.in_box(F.col("lon"), F.col("lat"), BOX)).select("id", "lon", "lat")


@query(f"select id, lon, lat from nodes where {IN_RING}")
def nodes_in_region(spark, d):
    return references.in_region(references.node_view(star.elements(spark, d)), [[RING]]).select("id", "lon", "lat")


@query(f"select id, lon, lat from nodes where {IN_RING}")
def nodes_in_large_region(spark, d):
    """The same region with many more vertices on its border takes the vectorised test."""
    dense = [(a[0] + (b[0] - a[0]) * k / 64, a[1] + (b[1] - a[1]) * k / 64) for a, b in zip(RING, RING[1:]) for k in range(64)]
    return references.in_region(references.node_view(star.elements(spark, d)), [[[*dense, dense[0]]]]).select("id", "lon", "lat")


@query("select * exclude (n_comment, c_acctbal) replace (upper(c_name) as c_name) from (select *, 'x' as n_comment from customer)")
def star_except_replace(spark, d):
    return star.table(spark, d, "customer").withColumn("n_comment", F.lit("x")).drop("n_comment", "c_acctbal").withColumn("c_name", F.upper("c_name"))


# ---- tag projections


def _way_features(spark, d):
    return star.way_tags(spark, d).select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("feature_id"), "tags", F.lit(None).cast("binary").alias("geometry"))


def _projected(spark, d, flat, keep_all=False, explode=None):
    ways = _way_features(spark, d)
    expanded = tags.expand_filter(ways, flat) if flat else None
    if flat:
        ways = ways.filter(tags.filter_column(tags.merge_filter(expanded)))
    return tags.project_tags(ways, expanded, keep_all, explode).drop("geometry")


@query(f"select 'way/' || id as feature_id, {TEXT} as tags from ways")
def tags_compact(spark, d):
    return _projected(spark, d, None).select("feature_id", tags_text().alias("tags"))


@query("""select 'way/' || id as feature_id, tags['area'] as area, tags['building'] as building, tags['highway'] as highway, tags['maxspeed'] as maxspeed,
tags['name:de'] as "name:de", tags['natural'] as "natural", tags['note'] as note from ways""")
def tags_exploded_all(spark, d):
    return _projected(spark, d, None, explode=True)


_WANTED = {"highway": "primary", "maxspeed": ["*0"], "name:*": True, "area": False}
_WHERE = "(tags['highway'] = 'primary' or tags['maxspeed'] like '%0' or list_contains(map_keys(tags), 'name:de')) and not list_contains(map_keys(tags), 'area')"


@query(f"""select 'way/' || id as feature_id, {tags_text_sql("map_from_entries(list_filter(map_entries(tags), lambda e: (e.key = 'highway' and e.value = 'primary') or (e.key = 'maxspeed' and e.value like '%0') or e.key = 'name:de'))")} as tags
from ways where {_WHERE}""")
def tags_compact_narrowed(spark, d):
    return _projected(spark, d, _WANTED, explode=False).select("feature_id", tags_text().alias("tags"))


@query(f"""select 'way/' || id as feature_id, case when tags['highway'] = 'primary' then 'primary' end as highway,
case when tags['maxspeed'] like '%0' then tags['maxspeed'] end as maxspeed, tags['name:de'] as "name:de" from ways where {_WHERE}""")
def tags_exploded_filtered(spark, d):
    return _projected(spark, d, _WANTED)


@query(f"select 'way/' || id as feature_id, {TEXT} as tags from ways where {_WHERE}")
def tags_keep_all(spark, d):
    return _projected(spark, d, _WANTED, keep_all=True).select("feature_id", tags_text().alias("tags"))


_GROUPS = {"roads": {"highway": ["primary", "secondary"], "maxspeed": True}, "areas": {"building": True, "natural": "wood"}}
_ROADS = "case when tags['highway'] in ('primary', 'secondary') then 'highway=' || tags['highway'] when tags['maxspeed'] is not null then 'maxspeed=' || tags['maxspeed'] end"
_AREAS = "case when tags['building'] is not null then 'building=' || tags['building'] when tags['natural'] = 'wood' then 'natural=wood' end"


@query(f"select * from (select 'way/' || id as feature_id, {_AREAS} as areas, {_ROADS} as roads from ways) where areas is not null or roads is not null")
def tags_grouped_exploded(spark, d):
    return _projected(spark, d, _GROUPS)


@query(f"""select feature_id, concat_ws(';', 'areas=' || areas, 'roads=' || roads) as tags
from (select 'way/' || id as feature_id, {_AREAS} as areas, {_ROADS} as roads from ways) where areas is not null or roads is not null""")
def tags_grouped_compact(spark, d):
    return _projected(spark, d, _GROUPS, explode=False).select("feature_id", tags_text().alias("tags"))


@query("select 'way/' || id as feature_id, tags['highway'] as highway, tags['natural'] as \"natural\" from ways")
def null_columns_dropped(spark, d):
    at = lambda k: F.try_element_at("tags", F.lit(k)).alias(k)
    return tags.drop_null_columns(_way_features(spark, d).select("feature_id", at("highway"), at("railway"), at("natural"), at("tunnel")))


@query("select key, count(*) as n from (select unnest(map_keys(tags)) as key from ways) group by key")
def key_counts(spark, d):
    return star.way_tags(spark, d).select(F.explode(F.map_keys("tags")).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


# ---- reference graph


@query("select distinct ref as id from members join relations using (id) where tags['type'] = 'multipolygon'")
def required_ways(spark, d):
    return references.distinct_refs(references.member_refs(references.relation_view(star.elements(spark, d))))


@query("""select id from ways where list_contains(map_keys(tags), 'building') union
select ref from members join relations using (id) where tags['type'] = 'multipolygon' and tags['boundary'] = 'BUILDING'""")
def filtered_or_required_ways(spark, d):
    built = star.way_tags(spark, d).filter(tags.filter_column({"building": True})).select("id")
    members = references.member_refs(references.relation_view(star.elements(spark, d)).filter(tags.filter_column({"boundary": "BUILDING"})))
    return built.union(references.distinct_refs(members)).distinct()


@query(f"select distinct w.id from (select id, unnest(refs) as ref from ways where len(refs) >= 2) w where w.ref in (select id from nodes where {IN_RING})")
def ways_touching_region(spark, d):
    e = star.elements(spark, d)
    return references.touching(references.node_refs(references.way_view(e)), references.in_region(references.node_view(e), [[RING]]))


@query("""select id from (select id, unnest(refs) as ref from ways where len(refs) >= 2) w left join (select id as ref, true as there from nodes where lat is not null) n using (ref)
group by id having bool_and(coalesce(there, false))""")
def ways_with_all_nodes(spark, d):
    e = star.elements(spark, d)
    return references.with_all_parts(references.node_refs(references.way_view(e)), references.node_view(e))


@query("""select r.id from (select distinct id from members join relations using (id) where tags['type'] = 'multipolygon') r anti join (
  select m.id from members m anti join (
    select id as ref from ways where len(refs) >= 2 anti_ways
  ) using (ref)) bad using (id)""".replace("where len(refs) >= 2 anti_ways", "where len(refs) >= 2"))
def relations_with_all_ways(spark, d):
    e = star.elements(spark, d)
    return references.with_all_parts(references.member_refs(references.relation_view(e)), references.way_view(e))


@query("select n.id, n.lon, n.lat, tags['brand'] as brand from nodes n where lat is not null and id in (select l_partkey from lineitem where l_quantity > 49)")
def nodes_semi_joined(spark, d):
    asked = star.table(spark, d, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))
    return references.node_view(star.elements(spark, d)).join(asked, "id", "left_semi").select("id", "lon", "lat", F.col("tags")["brand"].alias("brand"))


_POINTS = """, lines as (
  select w.id, list({'x': lon, 'y': lat} order by ref_idx) as points, count(*) filter (lat is null) = 0 as whole
  from (select id, unnest(refs) as ref, unnest(range(len(refs))) as ref_idx from ways where len(refs) >= 2) w left join nodes n on n.id = w.ref group by w.id
), deduped as (
  select id, whole, points, list_filter(points, lambda p, i: i = 1 or p.x <> points[i - 1].x or p.y <> points[i - 1].y) as dd from lines
)"""
#: Text of a coordinate as both engines give it.
_NUM = "regexp_replace(regexp_replace(printf('%.7f', {}), '0+$', ''), '\\.$', '')"
_WKT = "'LINESTRING (' || list_aggregate(list_transform(points, lambda p: " + _NUM.format("p.x") + " || ' ' || " + _NUM.format("p.y") + "), 'string_agg', ', ') || ')'"


def _lines(spark, d):
    e = star.elements(spark, d)
    return references.way_points(references.node_refs(references.way_view(e)), references.node_view(e)).filter("whole")


def _shapes(spark, d):
    """Lines of all ways as features."""
    return features.way_features(references.Bundle(None, _lines(spark, d).select("id", F.lit(None).cast("map<string,string>").alias("tags"), F.lit(None).cast("map<string,string>").alias("raw_tags"), "points"), None, None, None)).select(
        F.substring_index("feature_id", "/", -1).cast("long").alias("id"), "geometry"
    )


@query(_POINTS + f" select 'way/' || id as feature_id, {_WKT} as wkt from deduped where whole")
def way_linestrings(spark, d):
    return _lines(spark, d).select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("feature_id"), arrays.line_wkt(F.col("points")).alias("wkt"))


@query(_POINTS + """ select id, len(dd)::bigint as n_points, points[1] = points[-1] as closed, points[1].x as x0, points[-1].y as y1 from deduped where whole""")
def point_arrays(spark, d):
    p = F.col("points")
    return _lines(spark, d).select("id", F.size(arrays.without_repeats(p)).cast("long").alias("n_points"), arrays.is_closed(p).alias("closed"), arrays.first_point(p)["x"].alias("x0"), arrays.last_point(p)["y"].alias("y1"))


@query(_POINTS + """ select id, list_min(list_transform(points, lambda p: p.x)) as x_min, list_min(list_transform(points, lambda p: p.y)) as y_min,
list_max(list_transform(points, lambda p: p.x)) as x_max, list_max(list_transform(points, lambda p: p.y)) as y_max from deduped where whole""")
def way_envelopes(spark, d):
    return _shapes(spark, d).select("id", box_of("geometry").alias("e")).select("id", "e.*")


@query(_POINTS + """ select min(p.x) as x_min, min(p.y) as y_min, max(p.x) as x_max, max(p.y) as y_max from (select unnest(points) as p from deduped where whole)""")
def total_extent(spark, d):
    return sink.summary(_shapes(spark, d)).select("x_min", "y_min", "x_max", "y_max")


@query(_POINTS + """ select id, round(list_sum(list_transform(range(1, len(points)), lambda i: points[i].x * points[i + 1].y - points[i + 1].x * points[i].y)) / 2, 3) + 0.0 as area
from deduped where whole and len(dd) >= 4 and points[1] = points[-1]""")
def ring_areas(spark, d):
    p = F.col("points")
    return _lines(spark, d).filter(arrays.is_ring(p)).select("id", (F.round(arrays.signed_area(p), 3) + 0.0).alias("area"))


@query(_POINTS + """ select id, round(list_sum(list_transform(range(1, len(points)), lambda i: 2 * 6371.0088 * asin(least(1.0, sqrt(
pow(sin(radians(points[i + 1].y - points[i].y) / 2), 2) + cos(radians(points[i].y)) * cos(radians(points[i + 1].y)) * pow(sin(radians(points[i + 1].x - points[i].x) / 2), 2)))))), 3) as km
from deduped where whole""")
def way_lengths(spark, d):
    return _lines(spark, d).select("id", F.round(arrays.haversine_length(F.col("points"), 6371.0088), 3).alias("km"))


@query(_POINTS + """ select d.id, len(dd) >= 4 and points[1] = points[-1] and coalesce(tags['area'] <> 'no', true)
and (coalesce(tags['area'] = 'yes', false) or tags['building'] is not null or coalesce(tags['natural'] not in ('bay','cliff','coastline','ridge','strait','tree_row','valley','no','arete'), false)
or coalesce(tags['highway'] in ('services','rest_area','platform'), false)) as is_polygon
from deduped d join ways w on w.id = d.id where whole""")
def way_polygon_classifier(spark, d):
    rows = _lines(spark, d).join(star.way_tags(spark, d), "id")
    return rows.select("id", (arrays.is_ring(F.col("points")) & arrays.area_tags(F.col("tags"))).alias("is_polygon"))


#: Triangles with an area: polygons that need no repair, so that SQL can give their text.
_TRIANGLE = "len(dd) = 4 and points[1] = points[-1] and (dd[2].x - dd[1].x) * (dd[3].y - dd[1].y) <> (dd[3].x - dd[1].x) * (dd[2].y - dd[1].y)"


@query(_POINTS + """ select 'way/' || id as feature_id, 'POLYGON ((' || list_aggregate(list_transform(points, lambda p: """ + _NUM.format("p.x") + " || ' ' || " + _NUM.format("p.y") + """), 'string_agg', ', ') || '))' as wkt,
""" + f"{STRIPPED_TEXT} as tags from (select d.*, tags from deduped d join ways w using (id)) where whole and {_TRIANGLE} and tags['building'] = 'yes' and coalesce(tags['area'], '') <> 'no'")
def building_polygons(spark, d):
    b = references.resolve(star.elements(spark, d), flat={"building": True})
    corners = F.size(arrays.without_repeats(F.col("points")))
    p = lambda k: F.get(arrays.without_repeats(F.col("points")), F.lit(k))
    flat = (p(1)["x"] - p(0)["x"]) * (p(2)["y"] - p(0)["y"]) == (p(2)["x"] - p(0)["x"]) * (p(1)["y"] - p(0)["y"])
    triangles = b.ways.filter(features.is_area() & (corners == 4) & ~flat)
    return features.way_features(replace(b, ways=triangles)).select("feature_id", wkb_to_wkt("geometry").alias("wkt"), tags_text().alias("tags"))


# ---- relations
#
# Orders are rectangles on a grid, each drawn by two ways that have to be merged; customers are the relations of their orders. SQL
# counts the unit cells of each outer rectangle that no inner rectangle within it covers.

_MULTI = "(select m.* from members m join relations r using (id) where tags['type'] = 'multipolygon')"

_RECTANGLES = """with drawn as (
  select o_custkey as id, o_orderkey as k, o_orderkey * 7 % 23 as x0, o_orderkey * 13 % 19 as y0, o_orderkey * 7 % 23 + 1 + o_orderkey * 5 % 9 as x1, o_orderkey * 13 % 19 + 1 + o_orderkey * 11 % 8 as y1,
         case when o_custkey % 7 = 0 then 'inner' when o_orderstatus = 'O' then 'inner' else 'outer' end as said
  from orders
), named as (
  select *, case when bool_or(said = 'outer') over (partition by id) then said else 'outer' end as role, bool_or(k % 97 = 0 or k % 89 = 0) over (partition by id) as broken from drawn
), rects as (select * from named where not broken), holes as (
  select o.id, o.k, i.k as hole, i.x0, i.y0, i.x1, i.y1 from rects o join rects i on o.id = i.id and o.role = 'outer' and i.role = 'inner' and i.x0 >= o.x0 and i.y0 >= o.y0 and i.x1 <= o.x1 and i.y1 <= o.y1
), cells as (
  select id, k, x, unnest(range(y0, y1)) as y from (select id, k, y0, y1, unnest(range(x0, x1)) as x from rects where role = 'outer')
), covered as (
  select distinct id, x, y from cells c where not exists (select 1 from holes h where h.id = c.id and h.k = c.k and h.x0 <= c.x and c.x < h.x1 and h.y0 <= c.y and c.y < h.y1)
) """


def _rectangles(spark, d):
    """(id, geometry) of the relations; a way of order k is missing if 97 divides k, and ends early if 89 does."""
    k, n = F.col("o_orderkey"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    grid = star.table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), k.alias("k"), n.alias("n"), *[c.cast("double").alias(a) for a, c in {"x0": k * 7 % 23, "y0": k * 13 % 19, "x1": k * 7 % 23 + 1 + k * 5 % 9, "y1": k * 13 % 19 + 1 + k * 11 % 8}.items()],
        F.when((F.col("o_custkey") % 7 == 0) | (F.col("o_orderstatus") == "O"), "inner").when(F.col("o_orderstatus") == "F", "outer").alias("ref_role"),
    )
    at = lambda x, y: arrays.point(x, y)
    x0, y0, x1, y1 = map(F.col, ("x0", "y0", "x1", "y1"))
    # no two rectangles of a relation are cut at the same place
    low, high = x0 + F.col("n") % 400 / 1000, x0 + 0.5 + F.col("n") % 400 / 1000
    one, two = F.array(at(low, y0), at(x1, y0), at(x1, y1), at(high, y1)), F.array(at(high, y1), at(x0, y1), at(x0, y0), at(low, y0))
    ways = grid.select(F.explode(F.array(
        F.struct((F.col("k") * 2).alias("id"), one.alias("points")),
        F.struct((F.col("k") * 2 + 1).alias("id"), F.when(F.col("k") % 89 == 0, F.slice(two, 1, 3)).otherwise(two).alias("points")),
    )).alias("w")).select("w.*").filter("id % 2 = 0 or (id - 1) div 2 % 97 <> 0")
    members = grid.select("id", F.explode(F.array(F.col("k") * 2 + 1, F.col("k") * 2)).alias("ref"), "ref_role").withColumn("ref_idx", F.pmod(F.xxhash64("ref"), F.lit(1 << 30)).cast("int"))
    return features.relation_geometry(members, ways)


@F.pandas_udf(T.DoubleType())
def _area(shapes: pd.Series) -> pd.Series:
    def of(kind: str, parts: list) -> float:
        return sum(map(regions.polygon_area, [parts] if kind == "Polygon" else parts))

    return shapes.map(lambda s: of(*decode(s)))


@query(_RECTANGLES + "select id, count(*)::double as area from covered group by id", base=False)
def relation_areas(spark, d):
    return _rectangles(spark, d).select("id", F.round(_area("geometry"), 6).alias("area"))


@query(_RECTANGLES + """select id, min(x)::double as x_min, min(y)::double as y_min, max(x + 1)::double as x_max, max(y + 1)::double as y_max from covered group by id""", base=False)
def relation_extents(spark, d):
    return _rectangles(spark, d).select("id", box_of("geometry").alias("e")).select("id", "e.*")


@query(_RECTANGLES + """select id, count(*)::double as area from covered where id in (select id from rects group by id having bool_and(said = 'inner')) group by id""", base=False)
def relation_roles(spark, d):
    """Relations without an outer member: all their parts count as outer."""
    named = star.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.bool_and((F.col("o_custkey") % 7 == 0) | (F.col("o_orderstatus") == "O")).alias("inner")).filter("inner").select("id")
    return _rectangles(spark, d).join(named, "id", "left_semi").select("id", F.round(_area("geometry"), 6).alias("area"))


@query(_RECTANGLES + "select distinct id from named where id not in (select id from covered)", base=False)
def relations_without_area(spark, d):
    """Relations that miss a way, don't close, or of which nothing is left."""
    return star.table(spark, d, "orders").select(F.col("o_custkey").alias("id")).distinct().join(_rectangles(spark, d), "id", "left_anti")


# ---- several files


@query("""select feature_id, tag, extra from (
  select *, row_number() over (partition by feature_id order by f) as k from (
    select 'part/' || p_partkey as feature_id, p_brand as tag, null as extra, 0 as f from part where p_size <= 35
    union all select 'part/' || p_partkey, p_type, p_name, 1 from part where p_size >= 20)) where k = 1""", base=False)
def files_combined(spark, d):
    part = star.table(spark, d, "part")
    key = F.concat(F.lit("part/"), F.col("p_partkey").cast("string")).alias("feature_id")
    one = part.filter("p_size <= 35").select(key, F.col("p_brand").alias("tag"))
    two = part.filter("p_size >= 20").select(key, F.col("p_type").alias("tag"), F.col("p_name").alias("extra"))
    return dedupe.combine([one, two])


@query("""select * from (select p_partkey as id, p_brand as tag, null as extra from part where p_size <= 35
union all by name select p_partkey as id, p_name as extra from part where p_size >= 20)""", base=False)
def union_by_name(spark, d):
    part = star.table(spark, d, "part")
    return dedupe.union_by_name([part.filter("p_size <= 35").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("tag")), part.filter("p_size >= 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("extra"))])


@query("select p_partkey as id, p_brand as brand from part anti join (select l_partkey as p_partkey from lineitem where l_quantity > 40) using (p_partkey)", base=False)
def anti_join_seen(spark, d):
    part = star.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"))
    return part.join(star.table(spark, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("id")), "id", "left_anti")


# ---- order

_CELL = "least(greatest(floor(({v} - ({lo})) / {w} * 65536), 0), 65535)::bigint"


def _hilbert_sql() -> str:
    """One level of the curve after the other."""
    sql = f", h16 as (select id, lon, lat, {_CELL.format(v='lon', lo='-180.0', w='360.0')} as x, {_CELL.format(v='lat', lo='-90.0', w='180.0')} as y, 0::bigint as k from nodes where lat is not null)"
    for b in range(15, -1, -1):
        s = 1 << b
        sql += f""", h{b} as (select id, lon, lat, case when ry = 0 then case when rx = 1 then 65535 - y else y end else x end as x, case when ry = 0 then case when rx = 1 then 65535 - x else x end else y end as y,
        k + {s}::bigint * {s} * xor(rx * 3, ry) as k from (select *, (x & {s} > 0)::bigint as rx, (y & {s} > 0)::bigint as ry from (select id, lon, lat, x, y, k from h{b + 1})))"""
    return sql.replace("(x & ", "((x & ").replace(" > 0)::", ") > 0)::").replace("(y & ", "((y & ") + " select id, k as hilbert from h0"


@query(_hilbert_sql())
def hilbert_keys(spark, d):
    cell = lambda c, lo, hi: ordering.grid_cell(F.col(c), lo, hi)
    return references.node_view(star.elements(spark, d)).select("id", ordering.hilbert_key(cell("lon", -180.0, 180.0), cell("lat", -90.0, 90.0)).alias("hilbert"))


@query("""select id, (lon >= -90)::bigint + (lon >= 0)::bigint + (lon >= 90)::bigint as slab,
row_number() over (partition by (lon >= -90)::bigint + (lon >= 0)::bigint + (lon >= 90)::bigint order by lat, id) as place from nodes where lat is not null""")
def tile_slabs(spark, d):
    rows = references.node_view(star.elements(spark, d)).select("id", "lat", ordering.slab(F.col("lon"), [-90.0, 0.0, 90.0]).alias("slab"))
    return rows.select("id", "slab", F.row_number().over(W.partitionBy("slab").orderBy("lat", "id")).cast("long").alias("place"))


@query("select distinct l_partkey as id from lineitem order by id", base=False)
def sorted_ids(spark, d):
    return star.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().orderBy("id")


# ---- names of results


@query("""select page_id, regexp_matches(url, '^(ftp|https?|sftp|doi):') as is_url, left(sha256('["' || url || '"]'), 8) as hash8 from pages""", base=False)
def result_names(spark, d):
    """Whether an input is remote, and the part of a result's name that the ids asked for give."""

    @F.pandas_udf("is_url boolean, hash8 string")
    def named(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"is_url": urls.map(sources.is_url), "hash8": urls.map(lambda u: sink.result_name(["x"], ids=[u]).split("_")[-1].removesuffix(".parquet"))})

    return star.table(spark, d, "pages").select("page_id", named("url").alias("n")).select("page_id", "n.*")


# ---- an index of extracts (A15-A16, C10-C14, J24, K13, O4-O8): nations are extracts below their regions

_BOXES = """with tiles as (
  select 'n' || n_nationkey as id, n_name as name, 'r' || n_regionkey as parent, (n_nationkey * 37 % 50)::double as x0, (n_nationkey * 61 % 40)::double as y0, (10 + n_nationkey % 4 * 10)::double as w, (10 + n_nationkey % 3 * 10)::double as h from nation
  union all select 'r' || r_regionkey, r_name, 'earth', (r_regionkey * 20)::double, 0, 90, 60 from region
), areas as (
  select *, 6371.0072 ** 2 * radians(w) * (sin(radians(y0 + h)) - sin(radians(y0))) as area from tiles
)"""


def _index(spark, d) -> list[sources.Extract]:
    """Some thirty extracts, however large the other tables are."""
    nations = [(f"n{r.n_nationkey}", r.n_name, f"r{r.n_regionkey}", r.n_nationkey * 37 % 50, r.n_nationkey * 61 % 40, 10 + r.n_nationkey % 4 * 10, 10 + r.n_nationkey % 3 * 10) for r in star.table(spark, d, "nation").collect()]
    top = [(f"r{r.r_regionkey}", r.r_name, "earth", r.r_regionkey * 20, 0, 90, 60) for r in star.table(spark, d, "region").collect()]
    return sources.finished([sources.Extract(i, n, up, "", regions.from_box((x, y, x + w, y + h))) for i, n, up, x, y, w, h in nations + top])


@query(_BOXES + """ select t.id, 'earth_' || case when p.id is null then '' else lower(replace(p.name, ' ', '_')) || '_' end || lower(replace(t.name, ' ', '_')) as full_name from tiles t left join tiles p on t.parent = p.id""", base=False)
def hierarchical_names(spark, d):
    return spark.createDataFrame([(e.id, e.file_name) for e in _index(spark, d)], "id string, full_name string")


@query(_BOXES + " select id, round(area, 3) as area, row_number() over (order by area, id) as place from areas", base=False)
def extract_order(spark, d):
    return spark.createDataFrame([(e.id, round(e.area, 3), k + 1) for k, e in enumerate(_index(spark, d))], "id string, area double, place long")


@query(_BOXES + """ select row_number() over (order by coalesce(p.name, t.name), p.name is not null, t.name) as place, case when p.id is null then '  ' else '    ' end || t.name as line from tiles t left join tiles p on t.parent = p.id""", base=False)
def extract_tree(spark, d):
    lines = sources.tree_lines(_index(spark, d), "earth")[1:]
    return spark.createDataFrame([(k + 1, line.rsplit(" (", 1)[0]) for k, line in enumerate(lines)], "place long, line string")


@query(_BOXES + """, goals as (
  select r_regionkey as goal, 5.5 + 3 * r_regionkey as a, 4.25 + 2 * r_regionkey as b, 42.5 as c, 31.25 as d from region
), scored as (
  select goal, id, area, w * h as own, (c - a) * (d - b) as target, greatest(0, least(x0 + w, c) - greatest(x0, a)) * greatest(0, least(y0 + h, d) - greatest(y0, b)) as shared from areas cross join goals
) select goal::bigint as goal, id, round(iou, 9) as iou from (
  select goal, id, shared::double / (own + target - shared) as iou, row_number() over (partition by goal order by round(shared::double / (own + target - shared), 12) desc, area, id) as k from scored where shared > 0) where k = 1""", base=False)
def best_extract(spark, d):
    """The first extract of each region's cover."""
    geometry, index, rows = DriverGeometry(spark), _index(spark, d), []
    for k in range(5):
        found, iou = search.cover(geometry, index, regions.from_box((5.5 + 3 * k, 4.25 + 2 * k, 42.5, 31.25)), allow_uncovered=True)[0]
        rows.append((k, found.id, round(iou, 9)))
    return spark.createDataFrame(rows, "goal long, id string, iou double")


# ---- scalar functions (§2.9)


@query("""select p_partkey, starts_with(p_name, 'p') as starts, list_has_all(string_split(p_type, ' '), ['x']) as has_all, p_type like '%A%' as likes,
regexp_matches(p_brand, '^Brand#[1-3]') as matches, floor(p_size / 7.0)::bigint as f, p_size % 7 as m, round(p_retailprice, 1) as r, coalesce(nullif(p_size, 1), -1) as c from part""", base=False)
def scalar_functions(spark, d):
    from geoloom.functions.dialect import install

    install(spark)
    return star.table(spark, d, "part").selectExpr(
        "p_partkey", "starts_with(p_name, 'p') as starts", "list_has_all(split(p_type, ' '), array('x')) as has_all", "p_type like '%A%' as likes", "regexp_matches(p_brand, '^Brand#[1-3]') as matches",
        "cast(floor(p_size / 7.0D) as bigint) as f", "p_size % 7 as m", "round(p_retailprice, 1) as r", "coalesce(nullif(p_size, 1), -1) as c",
    )


# ---- whole pipelines


def _features_text(bundle):
    return features.all_features(bundle).select("feature_id", tags_text().alias("tags"), wkb_to_wkt("geometry").alias("wkt"))


_NODE_WKT = "'POINT (' || " + _NUM.format("lon") + " || ' ' || " + _NUM.format("lat") + " || ')'"


@query(f"select 'node/' || id as feature_id, {STRIPPED_TEXT} as tags, {_NODE_WKT} as wkt from nodes where {IN_RING} and list_contains(map_keys(tags), 'name:en')")
def pipeline_nodes(spark, d):
    b = references.resolve(star.elements(spark, d), flat={"name:en": True}, region=[[RING]])
    return features.node_features(b).select("feature_id", tags_text().alias("tags"), wkb_to_wkt("geometry").alias("wkt"))


@query(_POINTS + f""" select 'way/' || id as feature_id, {STRIPPED_TEXT} as tags, len(points)::bigint as n_points from (select d.*, tags from deduped d join ways w using (id))
where whole and tags['highway'] = 'primary' and cardinality({STRIPPED}) > 0 and id in (
  select w.id from (select id, unnest(refs) as ref from ways where len(refs) >= 2) w join nodes n on n.id = w.ref where {IN_RING})""")
def pipeline_ways_in_region(spark, d):
    b = references.resolve(star.elements(spark, d), flat={"highway": "primary"}, region=[[RING]])
    return b.ways.select(F.concat(F.lit("way/"), F.col("id").cast("string")).alias("feature_id"), tags_text().alias("tags"), F.size("points").cast("long").alias("n_points"))


@query(_POINTS + f""" select m.id, count(*) as n_members from {_MULTI} m group by m.id
having bool_and(m.ref in (select id from deduped where whole))""")
def pipeline_relation_members(spark, d):
    b = references.resolve(star.elements(spark, d), flat={"type": "multipolygon"})
    return b.members.join(references.with_all_parts(b.members, b.member_ways), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n_members"))


#: Ways that give lines.
_IS_LINE = """not (len(dd) >= 4 and points[1] = points[-1] and coalesce(tags['area'] <> 'no', true)
and (coalesce(tags['area'] = 'yes', false) or tags['building'] is not null or coalesce(tags['natural'] not in ('bay','cliff','coastline','ridge','strait','tree_row','valley','no','arete'), false)
or coalesce(tags['highway'] in ('services','rest_area','platform'), false)))"""


@query(_POINTS + f""" select 'node/' || id as feature_id, {STRIPPED_TEXT} as tags, {_NODE_WKT} as wkt from nodes where lat is not null and cardinality({STRIPPED}) > 0
union all select 'way/' || id, {STRIPPED_TEXT}, {_WKT} from (select d.*, tags from deduped d join ways w using (id)) where whole and cardinality({STRIPPED}) > 0 and {_IS_LINE}""")
def pipeline_points_and_lines(spark, d):
    """All features but areas, from the whole plan."""
    rows = features.all_features(references.resolve(star.elements(spark, d))).filter(wkb_type("geometry").isin("Point", "LineString"))
    return rows.select("feature_id", tags_text().alias("tags"), wkb_to_wkt("geometry").alias("wkt"))


@query()
def pipeline_features(spark, d):
    """All features, geometry as text; SQL has no repair of areas that cross themselves, which most are in this world."""
    return _features_text(references.resolve(star.elements(spark, d)))


@query()
def pipeline_features_in_region(spark, d):
    return _features_text(references.resolve(star.elements(spark, d), flat={"building": True, "boundary": True, "name": True}, region=[[RING]]))
