"""SimHash near-dedup by pivot distance tables.

1. One pass over the texts gives each document a 64-bit fingerprint; equal fingerprints become one class.
2. Each fingerprint gets a row of Hamming distances to reference fingerprints (pivots). All pivots equal a base
   pivot but for one of five blocks of bits, so the difference of two coordinates depends on one block only.
3. Fingerprints within two bits agree on at least three of the five blocks, so on all coordinates of three
   blocks: for each of the ten triples they meet in an equal-coordinates cell. A large cell is dealt out as
   pairs of bounded chunks.
4. In a cell, pairs whose coordinates differ by more than the limit are discarded, survivors are verified by
   XOR and population count, and the cell's links leave as a spanning forest.
5. Components of the forest are found on the executors.

No candidate is capped or sampled. Rows with a null id link like any other; a component of such rows alone is named null. Null text is
empty text; a text without words has fingerprint zero. Repeated rows get a row each. An empty table gives an empty result. The join that
gives each row its component is on fingerprints; where one holds a large share of all rows, adaptive execution splits it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.common import cut_lineage, fresh, map_batches, runs, shuffle_width
from geoloom.llm.components import connected_components, settle

MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a cell that one task compares; larger cells are split into pairs of chunks.
CHUNK = 2048
#: Hashes of a long text that are counted at a time.
COUNTED = 65536

_BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_PER_BLOCK = 12
_TRIPLES = tuple(combinations(range(5), 3))


def _pivots() -> np.ndarray:
    """The base pivot, then ``_PER_BLOCK`` references for each block."""
    rng = np.random.default_rng(20240)
    base = int(rng.integers(0, 2**63, dtype=np.int64)) * 2 + 1
    out = [base]
    for at, width in _BLOCKS:
        mask = ((1 << width) - 1) << at
        out += [(base & ~mask) | (int(x) << at) for x in rng.integers(0, 1 << width, _PER_BLOCK)]
    return np.array(out, np.uint64)


PIVOTS = _pivots()


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Majority of each bit over the XXH64 of all word shingles; words end at ASCII white space."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    total, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, COUNTED):
        part = words[at : at + COUNTED + shingle - 1]
        joined = map(b" ".join, zip(*(part[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in joined], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * total > n).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, fp long): a row per row of ``docs``; fp holds the 64 bits as a signed long."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(1).cast(pa.binary()).to_pylist()
        fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), one, "doc_id long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def cell_keys(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint ten keys: one for the coordinates of each triple of blocks."""
    table = pivot_table(fps)
    odd = np.uint64(0x9E3779B97F4A7C15)
    marks = []
    for b in range(len(_BLOCKS)):
        own = table[:, 1 + b * _PER_BLOCK : 1 + (b + 1) * _PER_BLOCK] - table[:, :1]
        mark = np.zeros(len(fps), np.uint64)
        for k in range(_PER_BLOCK):
            mark = (mark ^ (own[:, k] + 16).astype(np.uint64)) * odd
            mark ^= mark >> np.uint64(29)
        marks.append(mark)
    keys = np.empty((len(fps), len(_TRIPLES)), np.uint64)
    for t, triple in enumerate(_TRIPLES):
        key = np.full(len(fps), t + 1, np.uint64)
        for b in triple:
            key = (key ^ marks[b]) * odd
            key ^= key >> np.uint64(32)
        keys[:, t] = key
    return keys.view(np.int64)


def _keyed(b: pa.RecordBatch) -> pa.RecordBatch:
    fp, rep = b.column("fp").to_numpy(), b.column("rep").to_numpy()
    keys = cell_keys(fp.view(np.uint64))
    n = keys.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fp, n)), pa.array(np.repeat(rep, n))], ["key", "fp", "rep"])


def _near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) link: first by the largest coordinate difference, then exactly."""
    keep = np.arange(len(i))
    for p in range(0, table.shape[1], 4):
        if len(keep) < 64:
            break
        worst = np.abs(table[i[keep], p] - table[j[keep], p])
        keep = keep[worst <= MAX_BITS]
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= MAX_BITS]


def _links(group: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Root of each row, after all links within the groups (runs of equal numbers)."""
    table, root = pivot_table(fp), np.arange(len(fp))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(fp)])
    small = sizes <= 64
    in_small = np.repeat(small, sizes)
    for lag in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero(in_small[:-lag] & (group[lag:] == group[:-lag]))
        if len(i):
            k = i[_near(fp, table, i, i + lag)]
            root = settle(root, k, k + lag)
    for at, size in zip(starts[~small], sizes[~small]):
        rows = at + np.argsort(table[at : at + size, 0], kind="stable")
        first = table[rows, 0]
        ends = np.searchsorted(first, first + MAX_BITS, side="right")
        step = 64
        for k in range(0, size, step):
            a = np.arange(k, min(k + step, size))
            width = ends[a] - a - 1
            i = np.repeat(a, width)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
            i, j = rows[i], rows[j]
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            hit = _near(fp, table, i, j)
            root = settle(root, i[hit], j[hit])
    return root


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, ["key", "i", "j"]):
        key, i, j = (t.column(c).to_numpy() for c in ("key", "i", "j"))
        new = np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        group = np.cumsum(new)
        shared = np.bincount(group)[group] > 1
        if not shared.any():
            continue
        rep = t.column("rep").to_numpy()[shared]
        root = _links(group[shared], t.column("fp").to_numpy()[shared].view(np.uint64))
        own = root != np.arange(len(root))
        if own.any():
            yield pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], ["a", "b"])


def links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b): a spanning forest of all links between the classes (fp, rep)."""
    n = shuffle_width(classes.sparkSession)
    keyed = map_batches(classes.select("fp", "rep"), _keyed, "key long, fp long, rep long")
    large = keyed.groupBy("key").count().filter(F.col("count") > chunk).select("key", F.ceil(F.col("count") / chunk).cast("int").alias("k"))
    dealt = keyed.join(large, "key", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "rep")
    return dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_cells, "a long, b long")


def _components(fps: DataFrame) -> DataFrame:
    """(fp, component_id, lone): the smallest id in each fingerprint's component, and for one without ids a fingerprint that stands for it."""
    classes = cut_lineage(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = connected_components(links(classes.select("fp", F.col("fp").alias("rep"))), "a", "b")
    named = classes.join(found, classes.fp == found.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min("fp").alias("first"))
    return named.join(roots, "root").select("fp", "component_id", F.when(F.col("component_id").isNull(), F.col("first")).alias("lone"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, fingerprint string, component_id long): a row per row of ``docs``."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return fps.join(_components(fps), "fp").select("doc_id", hexed, "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the near copies: of each component one row stays, that with the smallest id, or any if all ids are null.

    Of rows that repeat the smallest id one stays.
    """
    fps = cut_lineage(fingerprints(docs, id_col, text_col))
    components = cut_lineage(_components(fps))
    kept = components.select(F.col("component_id").alias("__kept")).dropna().distinct()
    # the join leaves the rows in order of the id, so dropping repeats needs no further shuffle
    named = docs.filter(F.col(id_col).isNotNull())
    named = named.join(kept, named[id_col].cast("long") == kept["__kept"], "left_semi").dropDuplicates([id_col])
    nameless, at = docs.filter(F.col(id_col).isNull()), docs.schema.names.index(text_col)
    mark = fresh("fp", docs.columns)

    def marked(b: pa.RecordBatch) -> pa.RecordBatch:
        fp = np.array([fingerprint(t) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], [*b.schema.names, mark])

    alone = map_batches(nameless, marked, T.StructType([*docs.schema, T.StructField(mark, T.LongType())]))
    alone = alone.join(components.filter("fp = lone").select(F.col("fp").alias(mark)), mark, "left_semi").dropDuplicates([mark]).drop(mark)
    return named.unionByName(alone)
