"""Size of the Arrow batches that Python functions get."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows of a batch, so that a batch of long texts or large geometries stays small.
ROWS = 1024
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound(spark: SparkSession, rows: int = ROWS) -> None:
    """Lower the session's batch size to ``rows``; a smaller one stays."""
    now = int(spark.conf.get(_SETTING, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(_SETTING, rows)
