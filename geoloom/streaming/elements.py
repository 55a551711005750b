"""Tagged nodes as a stream of point features.

Ways and relations need elements that may come in any later file, so only nodes, whose features depend on one row, are
handled as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.functions import region as regions
from geoloom.functions.tags import has_tags
from geoloom.functions.wkb import points_wkb
from geoloom.plans.features import feature_id
from geoloom.plans.references import in_region, node_view, wanted, with_metadata_split
from geoloom.schema import ELEMENT


def read_elements(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream over parquet files of elements that arrive in a folder."""
    return spark.readStream.schema(ELEMENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def node_feature_stream(elements: DataFrame, flat: dict | None = None, region: regions.Region | None = None) -> DataFrame:
    """(feature_id, tags, geometry) of the wanted nodes."""
    nodes = node_view(with_metadata_split(elements)).filter(wanted(flat)).filter(has_tags())
    nodes = in_region(nodes, region) if region is not None else nodes
    return nodes.select(feature_id("node").alias("feature_id"), "tags", points_wkb("lon", "lat").alias("geometry"))
