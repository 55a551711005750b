"""Connected components over a distributed edge list.

Alternating large-star / small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond").
Edges stay on the executors; the driver sees one count and one checksum per round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import cut_lineage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for every node of the edges that isn't its own root."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    root = settle(np.arange(len(nodes)), x, y)
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def settle(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Merge the edges (x, y) into ``root``, an array of pointers to a smaller or equal index."""
    while len(x):
        rx, ry = root[x], root[y]
        lo, hi = np.minimum(rx, ry), np.maximum(rx, ry)
        open_ = lo != hi
        if not open_.any():
            break
        x, y, lo, hi = x[open_], y[open_], lo[open_], hi[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in batches:
        if t.num_rows:
            u, v = forest(t.column("u").to_numpy(), t.column("v").to_numpy())
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, component long): each node of the edges with the smallest node that it reaches.

    Edges with a null end and self-loops are left out; no edges give no rows. Each batch of edges is first
    reduced to a spanning forest, so a dense group sends a row per node and not one per link.
    """
    e = edges.dropna(subset=[a, b]).select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    e = e.filter(F.col("u") != F.col("v"))
    e = cut_lineage(e.mapInArrow(_contract, "u long, v long").distinct())
    seen = None
    while True:
        mark = e.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if (mark.n, mark.x) == seen or not mark.n:
            break
        seen = (mark.n, mark.x)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
