"""Embedding near-dedup by an epsilon grid order join.

Vectors of unit length with cosine c are sqrt(2 - 2c) apart, so pairs of a least cosine are pairs within an epsilon.

1. Equal vectors become one class (smallest id, count).
2. The covariance of all classes, summed on the executors, gives the principal dimensions. Classes are
   sorted by grid cells (of epsilon's width) on the leading ones; the sorted sequence is cut into intervals, and these into blocks.
3. An interval knows its box in all principal dimensions. Interval pairs meet on cells of the first two dimensions that they share or
   border on; pairs whose boxes are more than epsilon apart are provably distant and skipped.
4. A task joins two intervals: it halves the longer one again and again and skips parts whose boxes are too far apart. In small parts
   the leading dimensions and the length of the rest bound each cosine from above; pairs that this bound leaves are computed in
   double precision.
5. Each vector leaves a task once, with a count of links and the smallest class it reaches there, so a dense
   group sends a row per vector and not one per link. Components are found on the executors.

A vector travels once to its class, once into the sequence and once to each interval that its own isn't provably distant from. With S
bytes of vectors there are ``max(S / INTERVAL_BYTES, about sqrt(2 * cores))`` intervals, so a pair of intervals fits in a task and there is a
pair for each core; what is shuffled is at most that number times S.

Vectors that are null, zero or hold null or non-finite components link with nothing. Numbers keep the column's precision, products are in
double precision. Shorter vectors count as padded with
zeros. A null id links with nothing, has a null component and isn't kept. Repeated rows count as vectors of
their own. An empty table gives an empty result. No pair is capped or sampled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.functions import batches
from geoloom.llm.common import cut_lineage, shuffle_width
from geoloom.llm.components import connected_components, settle

COSINE = 0.9
#: Vectors in a block, dimensions of the grid, and vectors of a part that is multiplied out.
BLOCK, GRID, PART = 4096, 4, 512
#: Bytes of the vectors of a block and of an interval. Wide vectors make blocks of fewer rows, of a part at least.
BLOCK_BYTES, INTERVAL_BYTES = 4 << 20, 16 << 20
#: Share of the dimensions, the leading ones, in the bound of a cosine.
LEADING = 0.4
#: Share of a part's pairs from which all are computed.
DENSE = 0.02
#: Pairs of intervals that are broadcast; more are joined by a shuffle.
SMALL = 100_000
#: Rounding of projections and boxes, and of bounds in single precision.
SLACK, SLACK_SINGLE = 1e-6, 1e-4


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    sizes = np.diff(offsets)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]


def principal_dimensions(classes: DataFrame, width: int) -> np.ndarray:
    """Columns: eigenvectors of the covariance of all unit vectors, the leading one first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, n = np.zeros((width, width)), np.zeros(width), 0
        for b in batches:
            if b.num_rows:
                u = _unit(_matrix(b.column(0), width))
                total, mean, n = total + u.T @ u, mean + u.sum(axis=0), n + len(u)
        values = np.concatenate([total.ravel(), mean, [n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["at", "value"])

    rows = classes.select("embedding").mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value")).collect()
    values = np.array([v for _, v in sorted(rows)])
    n = max(values[-1], 1)
    mean = values[-1 - width : -1] / n
    _, vectors = np.linalg.eigh(values[: width * width].reshape(width, width) / n - np.outer(mean, mean))
    return vectors[:, ::-1].copy()


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> float:
    gap = np.maximum(0, np.maximum(lo_a - hi_b, lo_b - hi_a))
    return float(gap @ gap)


class Interval:
    """Classes of a part of the sequence: reps, counts, unit vectors, their principal dimensions, and rows that bound cosines."""

    def __init__(self, reps: np.ndarray, counts: np.ndarray, vectors: np.ndarray, axes: np.ndarray):
        self.reps, self.counts, self.unit = reps, counts, vectors
        self.projected = vectors @ axes
        k = max(1, math.ceil(LEADING * axes.shape[1]))
        rest = np.sqrt(np.einsum("ij,ij->i", self.projected[:, k:], self.projected[:, k:]))
        # x.y = leading part + rest, and the rest is at most the product of its lengths
        self.bound = np.concatenate([self.projected[:, :k], rest[:, None]], axis=1).astype(np.float32)
        # boxes of runs of PART rows; a part of the recursion consists of such runs
        starts = np.arange(0, len(vectors), PART)
        self.lo, self.hi = (f.reduceat(self.projected, starts, axis=0) if len(vectors) else self.projected for f in (np.minimum, np.maximum))


def part_pairs(a: Interval, b: Interval, i0: int, j0: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a and b of the links between two small parts."""
    i1, j1 = i0 + PART, j0 + PART
    width = min(PART, len(b.unit) - j0)
    at = np.flatnonzero(a.bound[i0:i1] @ b.bound[j0:j1].T >= cosine - SLACK_SINGLE)
    if len(at) > DENSE * PART * PART:
        at = np.flatnonzero(a.unit[i0:i1] @ b.unit[j0:j1].T >= cosine)
        return at // width + i0, at % width + j0
    x, y = at // width + i0, at % width + j0
    hit = np.einsum("ij,ij->i", a.unit[x], b.unit[y]) >= cosine
    return x[hit], y[hit]


def ego_join(a: Interval, b: Interval, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that link, in pieces, for two intervals in grid order; with ``same`` each pair once, and no row with itself."""
    limit = 2 - 2 * cosine + SLACK
    stack = [(0, len(a.lo), 0, len(b.lo))] if len(a.unit) and len(b.unit) else []
    while stack:
        i0, i1, j0, j1 = stack.pop()
        if same and j1 <= i0:
            continue
        if _apart(a.lo[i0:i1].min(axis=0), a.hi[i0:i1].max(axis=0), b.lo[j0:j1].min(axis=0), b.hi[j0:j1].max(axis=0)) > limit:
            continue
        if i1 - i0 == 1 and j1 - j0 == 1:
            x, y = part_pairs(a, b, i0 * PART, j0 * PART, cosine)
            if same and i0 == j0:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y
        elif same and (i0, i1) == (j0, j1):
            mid = (i0 + i1) // 2
            stack += [(i0, mid, i0, mid), (i0, mid, mid, i1), (mid, i1, mid, i1)]
        elif i1 - i0 >= j1 - j0:
            mid = (i0 + i1) // 2
            stack += [(i0, mid, j0, j1), (mid, i1, j0, j1)]
        else:
            mid = (j0 + j1) // 2
            stack += [(i0, i1, j0, mid), (i0, i1, mid, j1)]


def join_intervals(a: Interval, b: Interval, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, smallest class reached) for the classes of two intervals that link."""
    reps = a.reps if same else np.concatenate([a.reps, b.reps])
    order = np.argsort(reps, kind="stable")  # so that the smallest row is the smallest class
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    links, root = np.zeros(len(reps), np.int64), np.arange(len(reps))
    shift = 0 if same else len(a.reps)
    for x, y in ego_join(a, b, cosine, same):
        i, j = int(x.min()), int(y.min())
        np.add.at(links, x, b.counts[y]) if len(x) < 1000 else _count(links, i, x - i, b.counts[y])
        np.add.at(links, shift + y, a.counts[x]) if len(x) < 1000 else _count(links, shift + j, y - j, a.counts[x])
        u, v = rank[x], rank[shift + y]
        new = root[u] != root[v]
        root = settle(root, u[new], v[new])
    linked = links > 0
    return reps[linked], links[linked], reps[order[root[rank]]][linked]


def _count(links: np.ndarray, begin: int, at: np.ndarray, many: np.ndarray) -> None:
    n = np.zeros(PART, np.int64)
    np.add.at(n, at, many)
    links[begin : begin + PART] += n[: len(links) - begin]


def _blocks(width: int, axes: np.ndarray, kind: type):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, n = TaskContext.get().partitionId(), 0, [], 0
        size = min(BLOCK, max(PART, BLOCK_BYTES // (np.dtype(kind).itemsize * width)))

        def cut(t: pa.Table) -> pa.RecordBatch:
            nonlocal place
            m = _matrix(t.column("embedding"), width)
            p = _unit(m) @ axes
            place += 1
            values = [part, place, t.column("rep").to_numpy().tobytes(), t.column("n").to_numpy().tobytes(), m.astype(kind).tobytes(), (p.min(axis=0) - SLACK).tolist(), (p.max(axis=0) + SLACK).tolist()]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["part", "place", "reps", "counts", "vectors", "lo", "hi"])

        for b in rows:
            held.append(b)
            n += b.num_rows
            while n >= size:
                t = pa.Table.from_batches(held)
                yield cut(t.slice(0, size))
                held, n = t.slice(size).to_batches(), n - size
        if n:
            yield cut(pa.Table.from_batches(held))

    return run


def n_intervals(size: int, cores: int) -> int:
    """Intervals for ``size`` bytes of vectors: so many that each is small enough and that there is a pair for each core."""
    return max(1, math.ceil(size / INTERVAL_BYTES), math.ceil((math.sqrt(8 * cores + 1) - 1) / 2))


def links(classes: DataFrame, width: int, count: int, cosine: float = COSINE) -> DataFrame:
    """(a long, n long, b long): links of each of ``count`` classes and the smallest class reached, once per pair of intervals."""
    spark = classes.sparkSession
    batches.bound(spark)
    axes = principal_dimensions(classes, width)
    epsilon = float(np.sqrt(2 - 2 * cosine))
    grid = axes[:, :GRID]
    element = classes.schema["embedding"].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    parts = n_intervals(count * width * np.dtype(kind).itemsize, spark.sparkContext.defaultParallelism)

    def celled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            if b.num_rows:
                cells = np.floor(_unit(_matrix(b.column("embedding"), width)) @ grid / epsilon).astype(np.int64)
                key = np.zeros(len(cells), np.int64)
                for k in range(cells.shape[1]):
                    key = key * 1024 + cells[:, k] + 512
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "cell"])

    rows = classes.select("embedding", "rep", "n").mapInArrow(celled, f"embedding array<{element.simpleString()}>, rep long, n long, cell long")
    # the class breaks ties, so that one full cell spreads over intervals
    ordered = rows.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep")
    made = "part long, place long, reps binary, counts binary, vectors binary, lo array<double>, hi array<double>"
    blocks = cut_lineage(ordered.mapInArrow(_blocks(width, axes, kind), made))

    sides = blocks.select("part", F.posexplode(F.arrays_zip("lo", "hi")).alias("k", "side")).groupBy("part", "k").agg(F.min("side.lo").alias("lo"), F.max("side.hi").alias("hi"))
    listed = sides.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("k", "lo", "hi"))).alias("box"))
    boxes = listed.select("part", F.transform("box", lambda s: s["lo"]).alias("lo"), F.transform("box", lambda s: s["hi"]).alias("hi"))
    cell = lambda c, k: F.floor(F.get(c, F.lit(min(k, width - 1))) / epsilon)

    def keyed(side: str, border: int) -> DataFrame:
        out = boxes.select(F.col("part").alias(side), F.col("lo").alias(f"lo_{side}"), F.col("hi").alias(f"hi_{side}"))
        for k in (0, 1):
            out = out.withColumn(f"c{k}", F.explode(F.sequence(cell(f"lo_{side}", k) - border, cell(f"hi_{side}", k) + border)))
        return out

    gap = F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    near = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= 2 - 2 * cosine + SLACK
    pairs = keyed("a", 0).join(keyed("b", 1), ["c0", "c1"]).filter(F.col("a") <= F.col("b")).filter(near).select("a", "b").distinct()

    # each pair of intervals has a number, and its partition follows from the number
    number = F.expr("b * (b + 1) div 2 + a")
    sent = pairs.select("a", "b", number.alias("task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("part"))
    # at most a row for each two intervals: small for all but the largest tables
    work = (F.broadcast(sent) if parts**2 <= SMALL else sent).join(blocks.drop("lo", "hi"), "part")
    width_of_task = min(parts * (parts + 1) // 2, max(shuffle_width(spark), 4 * spark.sparkContext.defaultParallelism))
    dealt = work.repartitionById(width_of_task, F.pmod("task", F.lit(width_of_task)).cast("int")).sortWithinPartitions("task", "part", "place")

    def joined(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            one, two = (
                Interval(
                    *(np.frombuffer(b"".join(r[c] for r in held if r["part"] == part), np.int64) for c in ("reps", "counts")),
                    _unit(np.frombuffer(b"".join(r["vectors"] for r in held if r["part"] == part), kind).astype(np.float64).reshape(-1, width)),
                    axes,
                )
                for part in (held[0]["a"], held[0]["b"])
            )
            same = held[0]["a"] == held[0]["b"]
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in join_intervals(one, two, cosine, same)], ["a", "n", "b"])

        for b in rows:
            for r in b.to_pylist():
                if held and held[0]["task"] != r["task"]:
                    yield from flush()
                held.append(r)
        yield from flush()

    # blocks are large rows: a few in an Arrow batch
    return _in_small_batches(dealt, joined)


def _in_small_batches(dealt: DataFrame, run) -> DataFrame:
    spark, setting = dealt.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 4)
    try:
        return cut_lineage(dealt.mapInArrow(run, "a long, n long, b long"))
    finally:
        spark.conf.set(setting, before)


def digests(vectors: DataFrame) -> DataFrame:
    """``vectors`` (numbers, and a vector as the last column) with a hash in place of the vector."""
    names = vectors.columns[:-1]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            column = b.column(b.num_columns - 1)
            flat = column.flatten().to_numpy(zero_copy_only=False) + 0.0  # no negative zero
            ends = np.cumsum(np.diff(column.offsets.to_numpy()))
            marks = [hashlib.blake2b(flat[p:q].tobytes(), digest_size=16).digest() for p, q in zip([0, *ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(marks, pa.binary())], [*names, "digest"])

    return vectors.mapInArrow(run, ", ".join([f"{n} long" for n in names] + ["digest binary"]))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id long, n_links long, component_id long, kept boolean): a row per row of ``vectors``."""
    column = vectors.schema[vector_col].dataType
    element = "float" if isinstance(column, T.ArrayType) and isinstance(column.elementType, T.FloatType) else "double"
    v = F.col(vector_col).cast(f"array<{element}>")
    sound = F.coalesce(F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(sound, v).alias("embedding"))
    alone = rows.filter("embedding is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = cut_lineage(rows.filter("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    width, count = classes.agg(F.max(F.size("embedding")), F.count("*")).first()
    if not width:
        return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    found = links(classes, width, count, cosine)
    counted = found.groupBy("a").agg(F.sum("n").alias("links"))
    named = connected_components(found, "a", "b")
    # vectors needn't travel again: a class and its rows meet on a hash
    marked = digests(classes.select("rep", "n", "embedding"))
    of_class = marked.join(counted, F.col("rep") == counted.a, "left").join(named, F.col("rep") == F.col("node"), "left")
    of_class = of_class.select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = digests(rows.filter("embedding is not null")).join(of_class, "digest").select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
