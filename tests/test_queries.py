"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from compare import rows_of, sql_rows

from geoloom.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows_of(QUERIES[name](spark, sf_dir)) == sql_rows(sf_dir, ORACLES[name])


def test_pipeline_gives_each_feature_once(spark, sf_dir):
    ids = [r[0] for r in QUERIES["pipeline_features"](spark, sf_dir).select("feature_id").collect()]
    assert len(ids) == len(set(ids)) > 500


def test_region_gives_a_part_of_all_features(spark, sf_dir):
    part = {r[0] for r in QUERIES["pipeline_features_in_region"](spark, sf_dir).select("feature_id").collect()}
    assert part < {r[0] for r in QUERIES["pipeline_features"](spark, sf_dir).select("feature_id").collect()}


@pytest.mark.parametrize("name", ["pipeline_features", "pipeline_features_in_region"])
def test_refs_are_followed_once_and_areas_made_once(spark, sf_dir, name):
    """Points of ways and of members come from one shuffle; adaptive execution shows only at run time what it reuses."""
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)
    assert (plan.count("Generate posexplode(refs#"), plan.count("geoloom_area(")) == (1, 1)


def test_entry_and_names():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
