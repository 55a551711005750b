"""``spark.read.format("osmpbf")``: OpenStreetMap PBF files as element rows.

A partition is a range of bytes. Its task reads the range at once, finds the first blob that starts there and decodes the blobs
from there on with numpy, the last one to its end. The driver reads a file's size and first header only, however many blobs
there are. Paths may be local or of any file system that pyarrow opens by URI. The option ``kinds`` skips the decoding of other groups. (The
pushdown hook of Python sources isn't used: Spark 4.1 keeps what one query pushed down for later ones.)
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from geoloom.schema import ELEMENT
from geoloom.sources.files import opened

#: Bytes of a file in a partition.
PARTITION_BYTES = 16 << 20
#: Longest header of a blob, by the format.
HEADER_BYTES = 64 << 10
#: How the header of a data blob begins: its first field is the kind.
_DATA_MARK = b"\x0a\x07OSMData"
_MEMBER_KINDS = ("node", "way", "relation")
_ARROW = pa.schema([
    ("kind", pa.string()), ("id", pa.int64()), ("tags", pa.map_(pa.string(), pa.string())), ("refs", pa.list_(pa.int64())),
    ("lat", pa.float64()), ("lon", pa.float64()), ("ref_roles", pa.list_(pa.string())), ("ref_types", pa.list_(pa.string())),
])


def open_file(path: str):
    """A random-access file of a path or URI."""
    system, inner = opened(path)
    return system.open_input_file(inner)


# ---- protocol buffers


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message."""
    at, end = 0, len(data)
    while at < end:
        # most keys and lengths take one byte, so those are read without a call
        key, at = data[at], at + 1
        if key > 0x7F:
            key, at = varint(data, at - 1)
        wire = key & 7
        if wire == 0:
            value, at = varint(data, at)
        elif wire == 2:
            n, at = data[at], at + 1
            if n > 0x7F:
                n, at = varint(data, at - 1)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"Unknown wire type {wire}.")
        yield key >> 3, value


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def packed(data: memoryview) -> np.ndarray:
    """All varints of a packed field, as unsigned numbers."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    if (b < 0x80).all():
        return b.astype(np.uint64)
    ends = np.flatnonzero(b < 0x80)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & np.uint8(0x7F)).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def signed(values: np.ndarray) -> np.ndarray:
    """Zig-zag decoding."""
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


# ---- blobs


@dataclass(frozen=True)
class Range(InputPartition):
    """The blobs of a file that start at a byte from ``start`` on and before ``stop``."""

    path: str
    start: int
    stop: int


def ranges(path: str, size: int) -> list[Range]:
    """Ranges of about ``size`` bytes; one range if the headers of the file don't begin with their kind, as then no task can find one."""
    with open_file(path) as f:
        end = f.size()
        begin = f.read(5)
    step = max(1, size) if begin[4:] == _DATA_MARK[:1] else max(1, end)
    return [Range(path, at, min(end, at + step)) for at in range(0, end, step)]


class _Window:
    """Bytes of a file by their place in it: a part held in memory, the rest read when asked for."""

    def __init__(self, f, start: int, stop: int):
        self.f, self.size, self.start = f, f.size(), start
        f.seek(start)
        self.held = f.read(min(self.size, stop) - start)

    def __getitem__(self, span: slice) -> bytes:
        a, b = span.start - self.start, min(span.stop, self.size) - self.start
        if 0 <= a and b <= len(self.held):
            return self.held[a:b]
        have = self.held[a:] if a >= 0 else b""
        self.f.seek(span.start + len(have))
        return have + self.f.read(b - a - len(have))

    def header(self, at: int) -> tuple[bool, int, int] | None:
        """(whether it holds data, offset, end) of the blob whose header starts at ``at``; None if there is no whole one."""
        head = self[at : at + 4]
        n = int.from_bytes(head, "big")
        if len(head) < 4 or not 0 < n <= HEADER_BYTES or at + 4 + n > self.size:
            return None
        try:
            found = dict(fields(memoryview(self[at + 4 : at + 4 + n])))
            kind, body = bytes(found[1]), int(found[3])
        except (IndexError, KeyError, TypeError, ValueError):
            return None
        end = at + 4 + n + body
        return (kind == b"OSMData", at + 4 + n, end) if end <= self.size else None


def blobs(window: _Window, at: int, start: int, stop: int) -> list[tuple[int, int]] | None:
    """Going from header to header, from the one at ``at``: (offset, end) of the data blobs whose headers start from ``start`` on and
    before ``stop``; None if a blob on the way, or the one after them, isn't whole."""
    out = []
    while at < window.size:
        blob = window.header(at)
        if blob is None:
            return None
        if at >= stop:
            break
        data, begin, end = blob
        if data and at >= start:
            out.append((begin, end))
        at = end
    return out


def blobs_of(window: _Window, part: Range) -> list[tuple[int, int]]:
    """(offset, end) of a range's data blobs.

    Bytes count as a header only if whole blobs follow up to the range's end, and one more. Where some look like one and none
    counts (the file ends early, or a tag does), the way is gone from the start of the file, which tells.
    """
    like, at = part.start == 0, window.held.find(_DATA_MARK, 4) if part.start else -1
    while at >= 0 and part.start + at - 4 < part.stop:
        found = blobs(window, part.start + at - 4, part.start, part.stop)
        if found is not None:
            return found
        like, at = True, window.held.find(_DATA_MARK, at + 1)
    found = blobs(window, 0, part.start, part.stop) if like else []
    if found is None:
        raise ValueError(f"{part.path} isn't a PBF file, or ends within a blob.")
    return found


def inflate(blob: bytes) -> memoryview:
    message = dict(fields(memoryview(blob)))
    if 1 in message:
        return message[1]
    if 3 in message:
        return memoryview(zlib.decompress(message[3]))
    if 4 in message:
        import lzma

        return memoryview(lzma.decompress(message[4]))
    if 7 in message:
        import zstandard

        return memoryview(zstandard.ZstdDecompressor().decompress(message[7], max_output_size=message.get(2, 0)))
    raise ValueError("A blob has an unknown compression.")


def _packed_of(rows: list[dict], number: int) -> tuple[np.ndarray, np.ndarray]:
    """(varints, how many of each message) of a packed field of several messages, decoded in one go."""
    parts = [r.get(number, b"") for r in rows]
    joined = b"".join(parts)
    ends = np.r_[0, np.cumsum(np.frombuffer(joined, np.uint8) < 0x80)]
    return packed(memoryview(joined)), np.diff(ends[np.r_[0, np.cumsum([len(p) for p in parts])]])


def _running(deltas: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Running sums that start anew with each list."""
    total = np.r_[0, np.cumsum(deltas)]
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    return total[1:] - np.repeat(total[first], sizes)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _tags(strings: pa.Array, keys: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Maps; of a key that repeats within an element the last value counts."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    mark = owner * (len(strings) + 1) + keys.astype(np.int64)
    if len(np.unique(mark)) < len(mark):
        last = {int(m): k for k, m in enumerate(mark)}
        keep = np.array(sorted(last.values()), np.int64)
        keys, values, sizes = keys[keep], values[keep], np.bincount(owner[keep], minlength=len(sizes))
    return pa.MapArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), strings.take(pa.array(keys.astype(np.int64))), strings.take(pa.array(values.astype(np.int64))))


def _batch(kind: str, ids: np.ndarray, tags: pa.Array, **columns) -> pa.RecordBatch:
    n = len(ids)
    have = {"kind": pa.array([kind] * n, pa.string()), "id": pa.array(ids, pa.int64()), "tags": tags, **columns}
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(n, f.type)) for f in _ARROW], schema=_ARROW)


def decode_block(data: memoryview, kinds: frozenset[str] = frozenset(_MEMBER_KINDS)) -> Iterator[pa.RecordBatch]:
    """Record batches of a primitive block's elements of the given kinds."""
    strings, groups = None, []
    unit, lat0, lon0 = 100, 0, 0
    for number, value in fields(data):
        if number == 1:
            strings = pa.array([bytes(v).decode("utf-8", "replace") for _, v in fields(value)], pa.string())
        elif number == 2:
            groups.append(value)
        elif number == 17:
            unit = value
        elif number in (19, 20):
            value = value - (1 << 64) if value >> 63 else value
            lat0, lon0 = (value, lon0) if number == 19 else (lat0, value)
    degrees = lambda raw, offset: (offset + unit * raw) / 1e9
    for group in groups:
        nodes, ways, relations = [], [], []
        for number, value in fields(group):
            if number == 2 and "node" in kinds:
                yield from _dense(dict(fields(value)), strings, lambda v: degrees(v, lat0), lambda v: degrees(v, lon0))
            elif number in (1, 3, 4):
                (nodes, None, ways, relations)[number - 1].append(dict(fields(value)))
        for kind, rows in (("node", nodes), ("way", ways), ("relation", relations)):
            if not rows or kind not in kinds:
                continue
            (keys, sizes), (values, _) = _packed_of(rows, 2), _packed_of(rows, 3)
            tags = _tags(strings, keys, values, sizes)
            ids = np.array([r[1] for r in rows], np.uint64)
            if kind == "node":
                ids = signed(ids)
                lat, lon = (signed(np.array([r[n] for r in rows], np.uint64)) for n in (8, 9))
                yield _batch(kind, ids, tags, lat=pa.array(degrees(lat, lat0)), lon=pa.array(degrees(lon, lon0)))
                continue
            deltas, sizes = _packed_of(rows, 8 if kind == "way" else 9)
            columns = {"refs": _lists(pa.array(_running(signed(deltas), sizes), pa.int64()), sizes)}
            if kind == "relation":
                roles, types = (_packed_of(rows, n)[0].astype(np.int64) for n in (8, 10))
                columns |= {"ref_roles": _lists(strings.take(pa.array(roles)), sizes), "ref_types": _lists(pa.array(_MEMBER_KINDS).take(pa.array(types)), sizes)}
            yield _batch(kind, ids.view(np.int64), tags, **columns)


def _dense(message: dict, strings: pa.Array, to_lat, to_lon) -> Iterator[pa.RecordBatch]:
    ids, lat, lon = (np.cumsum(signed(packed(message[n]))) for n in (1, 8, 9))
    pairs = packed(message.get(10, memoryview(b""))).astype(np.int64)
    if len(pairs):
        # key, value, key, value, 0 for each node; values may be 0 as well, so ends are found by position
        ends, at = [], 0
        zeros = np.flatnonzero(pairs == 0)
        for z in zeros:
            if z >= at and (z - at) % 2 == 0:
                ends.append(z)
                at = z + 1
        ends = np.array(ends)
        sizes = (np.diff(np.r_[-1, ends]) - 1) // 2
        body = np.delete(pairs, ends)
        keys, values = body[::2], body[1::2]
    else:
        sizes, keys, values = np.zeros(len(ids), np.int64), pairs, pairs
    yield _batch("node", ids, _tags(strings, keys, values, sizes), lat=pa.array(to_lat(lat)), lon=pa.array(to_lon(lon)))


# ---- the data source


class PbfReader(DataSourceReader):
    def __init__(self, paths: list[str], partition_bytes: int, kinds: frozenset[str]):
        self.paths, self.partition_bytes, self.kinds = paths, partition_bytes, kinds

    def partitions(self) -> list[Range]:
        return [r for path in self.paths for r in ranges(path, self.partition_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.stop == 0:
            return
        with open_file(partition.path) as f:
            window = _Window(f, partition.start, partition.stop + 4 + HEADER_BYTES)
            for at, end in blobs_of(window, partition):
                yield from decode_block(inflate(window[at:end]), self.kinds)


class PbfSource(DataSource):
    """Options: ``path`` and ``kinds``, also comma-separated; ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self):
        return ELEMENT

    def reader(self, schema) -> PbfReader:
        return PbfReader([p.strip() for p in self.options["path"].split(",")], int(self.options.get("partitionBytes", PARTITION_BYTES)), frozenset(self.options.get("kinds", ",".join(_MEMBER_KINDS)).split(",")))


def read_pbf(spark: SparkSession, path: str | list[str], kinds: tuple[str, ...] = _MEMBER_KINDS) -> DataFrame:
    """Elements of one or several PBF files; groups of other kinds aren't decoded."""
    spark.dataSource.register(PbfSource)
    return spark.read.format("osmpbf").option("path", path if isinstance(path, str) else ",".join(path)).option("kinds", ",".join(kinds)).load()
