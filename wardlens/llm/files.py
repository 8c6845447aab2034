"""Files that tasks write and read by range, in the shared folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def fresh(folder: str, name: str) -> str:
    """A path no other attempt of a task has: only the paths that Spark keeps in a written table count."""
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def create(path: str) -> pa.NativeFile:
    """A new file to write, its folder made if need be."""
    system, place = fs.FileSystem.from_uri(path)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(place)


def opened(path: str) -> pa.NativeFile:
    """A file to read at any place, mapped into memory where it is local."""
    system, place = fs.FileSystem.from_uri(path)
    return pa.memory_map(place) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(place)
