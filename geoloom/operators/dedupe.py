"""Features of several files as one table."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def with_ordinals(frames: list[DataFrame], name: str = "__file") -> DataFrame:
    return union_by_name([f.withColumn(name, F.lit(k)) for k, f in enumerate(frames)])


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: that of the least ``order``. A partial aggregation, so repeats go before the shuffle."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order)).alias("__row"))
    return best.select(*[F.col("__row").getField(c).alias(c) if c != key else F.col(key) for c in df.columns])


def combine(frames: list[DataFrame], key: str = "feature_id") -> DataFrame:
    """Union by name without repeated features; the first frame's row stays."""
    return frames[0] if len(frames) == 1 else first_by(with_ordinals(frames), key, "__file").drop("__file")
