"""Files by path or URI, in any store that pyarrow knows; what runs on a cluster names a store that all its machines share."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path within it)."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def name_of(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def with_ending(path: str, ending: str) -> str:
    """``path`` with its last ending replaced."""
    head, name = path[: len(path) - len(name_of(path))], name_of(path)
    return head + (name.rsplit(".", 1)[0] if "." in name else name) + ending


def exists(path: str) -> bool:
    system, inner = opened(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def size(path: str) -> int:
    """Bytes of a file; 0 if it isn't one."""
    system, inner = opened(path)
    return system.get_file_info(inner).size or 0


def modified(path: str) -> float:
    """Seconds since 1970; now where the store doesn't say."""
    system, inner = opened(path)
    at = system.get_file_info(inner).mtime
    return at.timestamp() if at else time.time()


def remove(path: str) -> None:
    """Delete a file, if it is there."""
    if exists(path):
        system, inner = opened(path)
        system.delete_file(inner)


def make_parent(path: str) -> None:
    system, inner = opened(path)
    if "/" in inner.rstrip("/"):
        system.create_dir(inner.rstrip("/").rsplit("/", 1)[0] or "/", recursive=True)


def write(path: str, chunks: Iterable[bytes]) -> None:
    """A file that is there whole or not at all."""
    make_parent(path)
    system, inner = opened(path)
    with system.open_output_stream(f"{inner}.part") as out:
        for chunk in chunks:
            out.write(chunk)
    system.move(f"{inner}.part", inner)
