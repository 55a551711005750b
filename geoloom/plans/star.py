"""The star-schema tables as OpenStreetMap elements: parts are nodes, orders are ways, customers are relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.schema import ELEMENT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tags(**values: Column) -> Column:
    pairs = F.array(*[F.struct(F.lit(k.replace("__", ":")).alias("k"), v.cast("string").alias("v")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["v"].isNotNull()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, tags, lat, lon; parts of size over 49 have no place."""
    k, placed = F.col("p_partkey"), F.col("p_size") <= 49
    return table(spark, sf_dir, "part").select(
        k.alias("id"),
        _tags(
            brand=F.col("p_brand"), type=F.col("p_type"), name=F.when(k % 4 == 0, F.col("p_name")), name__en=F.when(k % 8 == 0, F.col("p_name")),
            created_by=F.when(k % 5 == 0, F.lit("import")), source=F.when(k % 7 == 0, F.lit("survey")), openGeoDB__id=F.when(k % 9 == 0, k),
        ).alias("tags"),
        F.when(placed, F.round((k * 104729 % 18000) / 100.0 - 90, 7)).alias("lat"),
        F.when(placed, F.round((k * 7919 % 36000) / 100.0 - 180, 7)).alias("lon"),
    )


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, refs: parts of an order by line; every third order ends where it begins."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("r"))
    refs = F.transform("r", lambda r: r["l_partkey"])
    return rows.select("id", F.when(F.col("id") % 3 == 0, F.concat(refs, F.slice(refs, 1, 1))).otherwise(refs).alias("refs"))


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"),
        _tags(
            highway=F.when(s == "F", F.when(k % 2 == 0, F.lit("primary")).otherwise(F.lit("secondary"))), building=F.when(s == "O", F.lit("yes")),
            natural=F.when(s == "P", F.when(k % 2 == 0, F.lit("wood")).otherwise(F.lit("cliff"))), maxspeed=F.when(s == "F", (k % 9) * 10),
            name__de=F.when(k % 10 == 0, F.col("o_orderpriority")), area=F.when(k % 11 == 0, F.lit("no")), note=F.when(k % 13 == 0, F.lit("x")),
        ).alias("tags"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ref, ref_role, ref_idx: orders of a customer."""
    role = F.when(F.col("o_orderstatus") == "F", F.lit("outer")).when(F.col("o_orderstatus") == "O", F.lit("inner"))
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("ref"), role.alias("role")))).alias("m"))
    return rows.select("id", "m")


def relation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), _tags(type=F.when(k % 3 == 0, F.lit("route")).otherwise(F.lit("multipolygon")), boundary=F.col("c_mktsegment"), name=F.when(k % 2 == 0, F.col("c_name"))).alias("tags"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three kinds in the schema of elements."""
    ways = way_tags(spark, sf_dir).join(way_nodes(spark, sf_dir), "id", "left")
    relations = relation_tags(spark, sf_dir).join(members(spark, sf_dir), "id", "left")
    relations = relations.select(
        "id", "tags", F.transform("m", lambda m: m["ref"]).alias("refs"), F.transform("m", lambda m: m["role"]).alias("ref_roles"),
        F.transform("m", lambda m: F.lit("way")).alias("ref_types"),
    )
    out = None
    for kind, frame in (("node", nodes(spark, sf_dir)), ("way", ways), ("relation", relations)):
        columns = [F.col(f.name) if f.name in frame.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ELEMENT if f.name != "kind"]
        part = frame.select(F.lit(kind).alias("kind"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


#: The same elements in SQL; each query appends to it what it asks.
SQL = """
with nodes as (
  select p_partkey as id, case when p_size <= 49 then round((p_partkey * 104729 % 18000) / 100.0::double - 90, 7) end as lat,
         case when p_size <= 49 then round((p_partkey * 7919 % 36000) / 100.0::double - 180, 7) end as lon,
         map_from_entries(list_filter([
           {'k': 'brand', 'v': p_brand}, {'k': 'type', 'v': p_type}, {'k': 'name', 'v': case when p_partkey % 4 = 0 then p_name end},
           {'k': 'name:en', 'v': case when p_partkey % 8 = 0 then p_name end}, {'k': 'created_by', 'v': case when p_partkey % 5 = 0 then 'import' end},
           {'k': 'source', 'v': case when p_partkey % 7 = 0 then 'survey' end}, {'k': 'openGeoDB:id', 'v': case when p_partkey % 9 = 0 then p_partkey::varchar end}
         ], lambda e: e.v is not null)) as tags
  from part
), listed as (
  select l_orderkey as id, list(l_partkey order by l_linenumber, l_partkey, l_suppkey) as r from lineitem group by l_orderkey
), ways as (
  select o_orderkey as id, case when o_orderkey % 3 = 0 then list_append(r, r[1]) else r end as refs,
         map_from_entries(list_filter([
           {'k': 'highway', 'v': case when o_orderstatus = 'F' then case when o_orderkey % 2 = 0 then 'primary' else 'secondary' end end},
           {'k': 'building', 'v': case when o_orderstatus = 'O' then 'yes' end},
           {'k': 'natural', 'v': case when o_orderstatus = 'P' then case when o_orderkey % 2 = 0 then 'wood' else 'cliff' end end},
           {'k': 'maxspeed', 'v': case when o_orderstatus = 'F' then (o_orderkey % 9 * 10)::varchar end},
           {'k': 'name:de', 'v': case when o_orderkey % 10 = 0 then o_orderpriority end},
           {'k': 'area', 'v': case when o_orderkey % 11 = 0 then 'no' end}, {'k': 'note', 'v': case when o_orderkey % 13 = 0 then 'x' end}
         ], lambda e: e.v is not null)) as tags
  from orders left join listed on listed.id = o_orderkey
), members as (
  select o_custkey as id, o_orderkey as ref, case o_orderstatus when 'F' then 'outer' when 'O' then 'inner' end as ref_role,
         row_number() over (partition by o_custkey order by o_orderkey) - 1 as ref_idx
  from orders
), relations as (
  select c_custkey as id, map_from_entries(list_filter([
           {'k': 'type', 'v': case when c_custkey % 3 = 0 then 'route' else 'multipolygon' end}, {'k': 'boundary', 'v': c_mktsegment},
           {'k': 'name', 'v': case when c_custkey % 2 = 0 then c_name end}
         ], lambda e: e.v is not null)) as tags
  from customer
)
"""


def tags_text(tags: Column | str = "tags") -> Column:
    """``k=v`` of all tags by key, as text that both engines agree on."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def tags_text_sql(tags: str = "tags") -> str:
    return f"list_aggregate(list_sort(list_transform(map_entries({tags}), lambda e: e.key || '=' || e.value)), 'string_agg', ';')"
