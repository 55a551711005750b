"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoloom.functions import batches


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The whole table; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the reliable checkpoint folder and read it from there.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset a folder of our own is made in local mode; on a cluster
    that is an error, as executors need a shared one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and the executors share.")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "geoloom-checkpoints"))
    return df.checkpoint(eager=True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, or with underscores until no column has it, whatever its case."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    """Number of partitions for an explicit repartition: the session's setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null is empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def map_parts(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded size."""
    batches.bound(df.sparkSession)
    return df.mapInArrow(fn, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType) -> DataFrame:
    """:func:`map_parts` with a function of one batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                yield fn(b)

    return map_parts(df, run, schema)


def runs(it: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Split a stream that is sorted by ``key`` into pieces of whole keys.

    A piece holds every row of the keys in it, so what stays in memory is a batch and the rows of one key;
    callers bound the rows of a key beforehand.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []
    for b in it:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in key]
        differs = np.zeros(b.num_rows, bool)
        for c in cols:
            differs[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(differs)
        if held:
            last = held[-1]
            same = all(last.column(k)[last.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in key)
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if len(cuts):
            yield pa.Table.from_batches([*held, b.slice(0, int(cuts[-1]))])
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
