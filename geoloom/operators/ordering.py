"""Spatial order: Hilbert keys and sort-tile-recursive slabs, spread over range partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16
#: Rows of a slab's cell in sort-tile-recursive order.
TILE = 100_000

Box = tuple[float, float, float, float]


def grid_cell(value: Column, low: float, high: float, bits: int = BITS) -> Column:
    """Integer cell of a coordinate in an extent; beyond it, the nearest cell."""
    cells = 1 << bits
    at = F.floor((value - F.lit(low)) / F.lit((high - low) or 1.0) * cells)
    return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("long")


def hilbert_key(x: Column, y: Column, bits: int = BITS) -> Column:
    """Place of a cell on the Hilbert curve; one JVM expression, folded over the bits from the highest."""
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(state: Column, level: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        rx, ry = ((state[c].bitwiseAND(side) > 0).cast("long") for c in "xy")
        flip = (ry == 0) & (rx == 1)
        a = F.when(flip, (1 << bits) - 1 - state["x"]).otherwise(state["x"])
        b = F.when(flip, (1 << bits) - 1 - state["y"]).otherwise(state["y"])
        turn = ry == 0
        d = state["d"] + side * side * F.lit(3).cast("long").bitwiseAND((rx * 3).bitwiseXOR(ry))
        return F.struct(F.when(turn, b).otherwise(a).alias("x"), F.when(turn, a).otherwise(b).alias("y"), d.alias("d"))

    levels = F.array(*[F.lit(k) for k in range(bits - 1, -1, -1)])
    return F.aggregate(levels, start, step)["d"]


def extent(df: DataFrame, x: str, y: str) -> Box | None:
    r = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    return None if r[0] is None else tuple(r)


def sort_by_hilbert(df: DataFrame, x: str, y: str, box: Box | None = None, partitions: int | None = None) -> DataFrame:
    """Rows in Hilbert order across and within partitions."""
    box = box or extent(df, x, y)
    if box is None:
        return df
    key = hilbert_key(grid_cell(F.col(x), box[0], box[2]), grid_cell(F.col(y), box[1], box[3])).alias("__key")
    keyed = df.select("*", key)
    spread = keyed.repartitionByRange(partitions, "__key", x, y) if partitions else keyed.repartitionByRange("__key", x, y)
    return spread.sortWithinPartitions("__key", x, y).drop("__key")


def slab_bounds(df: DataFrame, x: str, tile: int = TILE) -> list[float]:
    """x at which slabs of about equally many rows part; sqrt(rows / tile) slabs."""
    n = df.count()
    slabs = max(1, math.ceil(math.sqrt(n / tile)))
    return df.approxQuantile(x, [k / slabs for k in range(1, slabs)], 0.001) if slabs > 1 else []


def slab(x: Column, bounds: list[float]) -> Column:
    """Number of bounds at or below x."""
    return F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]).cast("array<double>"), lambda b: b <= x)).cast("long")


def sort_by_tiles(df: DataFrame, x: str, y: str, tile: int = TILE, partitions: int | None = None) -> DataFrame:
    """Sort-tile-recursive: slabs along x, each sorted along y."""
    keyed = df.select("*", slab(F.col(x), slab_bounds(df, x, tile)).alias("__key"))
    spread = keyed.repartitionByRange(partitions, "__key", y, x) if partitions else keyed.repartitionByRange("__key", y, x)
    return spread.sortWithinPartitions("__key", y, x).drop("__key")
