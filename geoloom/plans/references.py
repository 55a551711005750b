"""The reference graph: relation -> way -> node.

The way refs join the node coordinates once, and one aggregation by way then gives the ordered points and whether all
nodes were there. With a region, ways and relations are first reduced to those that the region touches; if it is a large part
of the globe, so that this would spare little, the one join tells what it touches as well.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import jts
from geoloom.functions import region as regions
from geoloom.functions.arrays import in_box, in_rings, point
from geoloom.functions.tags import elements_with_ids, filter_column, has_tags, strip_metadata
from geoloom.schema import RELATION_TYPES

#: Edges of a region up to which the test is one JVM expression.
NATIVE_EDGES = 64
#: Share of the globe from which on a region's box is wide: ways are not looked at beforehand.
WIDE = 0.1


@dataclass(frozen=True)
class Bundle:
    """What features are made of; all frames are lazy.

    ``nodes``: id, tags, lat, lon. ``ways``: id, tags, raw_tags, points of wanted ways. ``relations``: id, tags of wanted relations.
    ``members``: id, ref, ref_role, ref_idx of theirs. ``member_ways``: id, points of the ways among them that have all nodes;
    relations that miss one have no geometry. With a wide region it has ``hit`` as well, whether a way is inside: relations without
    such a way have no geometry.
    """

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame
    members: DataFrame
    member_ways: DataFrame


# ---- views of elements


def node_view(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("kind") == "node") & F.col("lat").isNotNull() & F.col("lon").isNotNull())


def way_view(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("kind") == "way") & (F.size("refs") >= 2))


def relation_view(elements: DataFrame) -> DataFrame:
    return elements.filter((F.col("kind") == "relation") & (F.size("refs") > 0) & F.try_element_at("tags", F.lit("type")).isin(*RELATION_TYPES))


def with_metadata_split(elements: DataFrame, strip: bool = True) -> DataFrame:
    """``raw_tags`` as read, and ``tags`` without metadata."""
    return elements.withColumn("raw_tags", F.col("tags")).withColumn("tags", strip_metadata("tags") if strip else F.col("tags"))


def wanted(flat: dict | None, sql: str | None = None, ids: Iterable[str] | None = None, loose_ids: bool = False) -> Column:
    """Predicate of the elements asked for: raw tags for the filter, stripped ones for SQL, ids with their kind unless ``loose_ids``."""
    test = has_tags("raw_tags")
    for part in (filter_column(flat, "raw_tags"), F.expr(sql) if sql else None, elements_with_ids(ids, loose=loose_ids)):
        test = test if part is None else test & F.coalesce(part, F.lit(False))
    return test


# ---- edges


def member_refs(relations: DataFrame) -> DataFrame:
    """(id, ref, ref_role, ref_idx): a row per way member; roles that are missing or empty are null."""
    zipped = F.arrays_zip("refs", F.coalesce("ref_roles", F.array().cast("array<string>")).alias("ref_roles"), F.col("ref_types"))
    rows = relations.select("id", F.posexplode(zipped).alias("ref_idx", "m"))
    return rows.filter("m.ref_types = 'way'").select("id", F.col("m.refs").alias("ref"), F.nullif("m.ref_roles", F.lit("")).alias("ref_role"), "ref_idx")


def node_refs(ways: DataFrame, *also: str) -> DataFrame:
    """(id, ref, ref_idx), and the columns ``also``: a row per node of a way."""
    return ways.select("id", *also, F.posexplode("refs").alias("ref_idx", "ref")).select("id", "ref", "ref_idx", *also)


def distinct_refs(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("ref").alias("id")).distinct()


def with_all_parts(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(id): elements of which every ref is among the ids of ``parts``; a null ref is missing."""
    known = parts.select(F.col("id").alias("ref")).distinct().withColumn("there", F.lit(True))
    return edges.join(known, "ref", "left").groupBy("id").agg(F.bool_and(F.coalesce("there", F.lit(False))).alias("whole")).filter("whole").select("id")


def touching(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """(id): elements with a ref among ``hits``."""
    return edges.join(hits.select(F.col("id").alias("ref")), "ref", "left_semi").select("id").distinct()


def way_points(refs: DataFrame, nodes: DataFrame, *also: str, inside: Column | None = None) -> DataFrame:
    """(id, points, whole): ordered points of each way, and whether all its nodes have coordinates; its columns ``also``; and ``hit``,
    whether a node of it is ``inside``, if that is asked.

    All comes from one list, so that plans which ask for different columns of this share its shuffles.
    """
    at = nodes.select(F.col("id").alias("ref"), point(F.col("lon"), F.col("lat")).alias("p"), *([] if inside is None else [inside.alias("inside")]))
    rows = refs.join(at, "ref", "left")
    row = F.struct("ref_idx", "p", *also, *([] if inside is None else ["inside"]))
    listed = rows.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("listed"))
    hit = [] if inside is None else [F.coalesce(F.exists("listed", lambda s: s["inside"]), F.lit(False)).alias("hit")]
    return listed.select("id", F.transform("listed", lambda s: s["p"]).alias("points"), (~F.exists("listed", lambda s: s["p"].isNull())).alias("whole"), *[F.col("listed")[0][c].alias(c) for c in also], *hit)


# ---- regions


def is_wide(region: regions.Region) -> bool:
    x_min, y_min, x_max, y_max = regions.bounds(region)
    return (x_max - x_min) * (y_max - y_min) >= WIDE * 360 * 180


def inside_region(spark: SparkSession, region: regions.Region) -> Column:
    """Whether a node is inside or on the border: first by box, which parquet can prune by, then exactly."""
    box = regions.bounds(region)
    near = in_box(F.col("lon"), F.col("lat"), box)
    if len(region) == 1 and len(region[0]) == 1 and len(region[0][0]) == 5 and {x for x, _ in region[0][0]} == {box[0], box[2]} and {y for _, y in region[0][0]} == {box[1], box[3]}:
        return near
    if len(region) == 1 and sum(len(r) for p in region for r in p) <= NATIVE_EDGES:
        return near & in_rings(F.col("lon"), F.col("lat"), region[0])

    if jts.install(spark):
        return near & jts.inside(F.col("lon"), F.col("lat"), region)

    @F.pandas_udf(T.BooleanType())
    def inside(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(regions.contains(region, x.to_numpy(np.float64), y.to_numpy(np.float64)))

    return near & inside("lon", "lat")


def in_region(nodes: DataFrame, region: regions.Region) -> DataFrame:
    """Nodes inside or on the border."""
    return nodes.filter(inside_region(nodes.sparkSession, region))


# ---- the bundle


def resolve(elements: DataFrame, flat: dict | None = None, sql: str | None = None, ids: Iterable[str] | None = None, region: regions.Region | None = None, strip: bool = True, loose_ids: bool = False) -> Bundle:
    """Follow references from the wanted elements to what their geometry needs.

    A way counts as inside a region if one of its nodes is, and then stays whole; a relation if one of its ways is. Elements with
    missing parts are dropped, and those without tags left.
    """
    split = with_metadata_split(elements, strip)
    keep = wanted(flat, sql, list(ids) if ids is not None else None, loose_ids)
    nodes, ways, relations = node_view(split), way_view(split), relation_view(split)

    r_wanted = relations.filter(keep)
    members = member_refs(r_wanted)
    w_refs = ways.select("id", "refs", keep.alias("asked"))
    w_tags = split.filter((F.col("kind") == "way") & keep & has_tags()).select("id", "tags", "raw_tags")
    n_wanted = nodes.filter(keep)

    inside = None
    if region is not None:
        n_wanted = in_region(n_wanted, region)
    if region is not None and is_wide(region):
        inside = inside_region(elements.sparkSession, region)
    elif region is not None:
        hits = in_region(nodes, region).select("id")
        needed = distinct_refs(members).withColumn("needed", F.lit(True))
        candidates = w_refs.join(needed, "id", "left").filter(F.col("asked") | F.col("needed"))
        w_hits = touching(node_refs(candidates), hits)
        members = members.join(touching(members, w_hits), "id", "left_semi")
        w_refs = w_refs.join(w_hits.withColumn("hit", F.lit(True)), "id", "left").withColumn("asked", F.col("asked") & F.coalesce("hit", F.lit(False))).drop("hit")

    needed = distinct_refs(members).withColumn("needed", F.lit(True))
    flagged = w_refs.join(needed, "id", "left").withColumn("needed", F.coalesce("needed", F.lit(False))).filter(F.col("asked") | F.col("needed"))
    # ways and members take their points from one plan up to its last shuffle; tags join only the ways asked for
    points = way_points(node_refs(flagged, "asked", "needed"), nodes, "asked", "needed", inside=inside).filter("whole")
    hit = [] if inside is None else ["hit"]

    return Bundle(
        n_wanted.filter(has_tags()).select("id", "tags", "lat", "lon"),
        w_tags.join(points.filter(" and ".join(["asked", *hit])).select("id", "points"), "id"),
        r_wanted.filter(has_tags()).select("id", "tags"),
        members,
        points.filter("needed").select("id", "points", *hit),
    )
