"""Files in the shared folder, written and read in parts by executors."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse


def _system(path: str):
    """The file system of a path and the path there; None for one that the machine's own calls reach."""
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return None, unquote(parts.path) if parts.scheme else path
    from pyarrow import fs  # HDFS and object stores

    return fs.FileSystem.from_uri(path)


def put(path: str, pieces: Iterator[bytes]) -> int:
    """Write a file whole or not at all: under another name first, so a lost task leaves nothing that looks finished. Returns its size."""
    system, own = _system(path)
    part, size = f"{own}.{uuid.uuid4().hex}.part", 0
    if system is None:
        os.makedirs(os.path.dirname(own), exist_ok=True)
    else:
        system.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with open(part, "wb") if system is None else system.open_output_stream(part) as f:
        for piece in pieces:
            f.write(piece)
            size += len(piece)
    os.replace(part, own) if system is None else system.move(part, own)
    return size


def pieces(path: str, size: int = 1 << 18) -> Iterator[bytes]:
    system, own = _system(path)
    with open(own, "rb") if system is None else system.open_input_file(own) as f:
        while piece := f.read(size):
            yield piece


class Reader:
    """A file that is read from given offsets."""

    def __init__(self, path: str):
        system, own = _system(path)
        self.file = open(own, "rb") if system is None else system.open_input_file(own)  # noqa: SIM115
        self.read_bytes = 0

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        self.read_bytes += len(out)
        return out
