"""A small encoder of PBF files, for tests."""

from __future__ import annotations

import struct
import zlib


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zigzag(n: int) -> int:
    return (n << 1) ^ (n >> 63)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(values) -> bytes:
    return b"".join(map(varint, values))


def deltas(values) -> list[int]:
    return [zigzag(b - a) for a, b in zip([0, *values], values)]


def blob(kind: str, data: bytes, compress: bool = True) -> bytes:
    body = field(2, len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
    header = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(header)) + header + body


def block(elements: list[dict], dense: bool = True) -> bytes:
    strings = [""]
    index = {"": 0}

    def s(text: str) -> int:
        if text not in index:
            index[text] = len(strings)
            strings.append(text)
        return index[text]

    groups = []
    nodes = [e for e in elements if e["kind"] == "node"]
    raw = lambda v: round(v * 1e7)
    if nodes and dense:
        pairs = [x for e in nodes for x in [*(v for k, t in (e.get("tags") or {}).items() for v in (s(k), s(t))), 0]]
        message = field(1, packed(deltas([e["id"] for e in nodes]))) + field(8, packed(deltas([raw(e["lat"]) for e in nodes]))) + field(9, packed(deltas([raw(e["lon"]) for e in nodes])))
        groups.append(field(2, message + (field(10, packed(pairs)) if any(pairs) else b"")))
    elif nodes:
        groups.append(b"".join(field(1, field(1, zigzag(e["id"])) + tags(e, s) + field(8, zigzag(raw(e["lat"]))) + field(9, zigzag(raw(e["lon"])))) for e in nodes))
    ways = [e for e in elements if e["kind"] == "way"]
    if ways:
        groups.append(b"".join(field(3, field(1, e["id"]) + tags(e, s) + field(8, packed(deltas(e["refs"])))) for e in ways))
    relations = [e for e in elements if e["kind"] == "relation"]
    if relations:
        kinds = {"node": 0, "way": 1, "relation": 2}
        groups.append(b"".join(
            field(4, field(1, e["id"]) + tags(e, s) + field(8, packed(s(r or "") for r in e["ref_roles"])) + field(9, packed(deltas(e["refs"]))) + field(10, packed(kinds[t] for t in e["ref_types"])))
            for e in relations
        ))
    table = b"".join(field(1, t.encode()) for t in strings)
    return field(1, table) + b"".join(field(2, g) for g in groups)


def tags(element: dict, s) -> bytes:
    pairs = element.get("tags") or {}
    return field(2, packed(s(k) for k in pairs)) + field(3, packed(s(v) for v in pairs.values())) if pairs else b""


def write_pbf(path, elements: list[dict], per_block: int = 8, dense: bool = True, compress: bool = True) -> None:
    header = field(4, b"OsmSchema-V0.6") + field(4, b"DenseNodes")
    with open(path, "wb") as f:
        f.write(blob("OSMHeader", header, compress))
        for k in range(0, len(elements), per_block):
            f.write(blob("OSMData", block(elements[k : k + per_block], dense), compress))
