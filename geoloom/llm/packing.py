"""Best-fit decreasing packing of token sequences.

1. One pass encodes each document, adds the separator and cuts it into full windows and a rest; only
   (id, start, length, checksum) rows leave it, never token ids.
2. Pieces are dealt by a hash into as many parts as the session shuffles to and sorted by length, longest first.
3. Each part is packed as a stream: a segment tree over remaining capacities finds the tightest open window
   that still has room. What a part keeps in memory is its open windows.

Parts are independent, so a lost task repeats its own part only, and a sort with a full tie-break makes the
repeat equal. A sequence's number is its part's number and its place in the part.

Null text is empty: its one piece is the separator. Repeated rows are packed as separate documents. Null ids
are kept. An empty table gives an empty result. A separator that falls on a window's edge opens a new piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import map_batches, shuffle_width, texts_of
from geoloom.llm.tokens import RANKS, token_ids

WINDOW = 1024
SEPARATOR = 0
#: Bits of a sequence's number that count within a part.
PLACE_BITS = 40

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PACKED = f"{_PIECE}, sequence_id long, offset long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks: str = RANKS) -> DataFrame:
    """A row per piece of at most ``window`` tokens: the full windows of a document, then its rest."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for key, text in zip(b.column(0).to_pylist(), texts_of(b)):
            ids = np.append(token_ids(text, ranks), np.uint32(SEPARATOR)).astype("<u4")
            for at in range(0, len(ids), window):
                part = ids[at : at + window]
                out.append((key, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), one, _PIECE)


class OpenWindows:
    """Windows with room left, under a segment tree indexed by that room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, room: int, sequence: int) -> None:
        if room:
            self.at[room].append(sequence)
            self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, sequence) of the open window with the least room of ``length`` or more."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and not (node % 2 == 0 and count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()


def pack_lengths(lengths: Iterator[int], window: int, bins: OpenWindows | None = None, first: int = 0) -> Iterator[tuple[int, int]]:
    """(sequence, offset) of each length, for lengths that don't grow."""
    bins = bins or OpenWindows(window)
    for n in lengths:
        found = bins.take(n)
        room, sequence = found or (window, first)
        if not found:
            first += 1
        bins.put(room - n, sequence)
        yield sequence, window - room


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ranks: str = RANKS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; within a sequence offsets run from 0 without gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = OpenWindows(window), TaskContext.get().partitionId() << PLACE_BITS
        for b in batches:
            if b.num_rows:
                places = list(pack_lengths(b.column("length").to_pylist(), window, bins, first))
                first = max(first, max(s for s, _ in places) + 1)
                sequence, offset = zip(*places)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*b.schema.names, "sequence_id", "offset"])

    cut = pieces(docs, id_col, text_col, window, ranks)
    dealt = cut.repartition(shuffle_width(docs.sparkSession), F.xxhash64("doc_id", "start", "ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(run, _PACKED)
