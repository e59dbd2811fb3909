"""Arrays in the shared folder that workers map into memory.

A folder on a mounted file system is mapped in place. From any other store a file is
copied once to the folder that Spark gives an executor for files, and mapped there.
"""

from __future__ import annotations

import functools
import os
import uuid
from urllib.parse import urlsplit

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a mounted folder, or None for another store."""
    parts = urlsplit(uri)
    return parts.path if parts.scheme in ("", "file") else None


def save(uri: str, array: np.ndarray) -> None:
    """Write an array under its final name in one step, so that a repeated task does no harm."""
    path = local_path(uri)
    if path is None:
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(uri)
        with store.open_output_stream(place) as out:
            np.lib.format.write_array(out, array, allow_pickle=False)
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.lib.format.write_array(out, array, allow_pickle=False)
    os.replace(part, path)


@functools.lru_cache(maxsize=4096)
def mapped(uri: str) -> np.ndarray:
    """The array behind ``uri``, memory-mapped and read-only."""
    path = local_path(uri)
    if path is None:
        path = _fetched(uri)
    return np.load(path, mmap_mode="r")


def _fetched(uri: str) -> str:
    from pyarrow import fs
    from pyspark import SparkFiles

    path = os.path.join(SparkFiles.getRootDirectory(), uri.rstrip("/").replace("/", "_"))
    if not os.path.exists(path):
        store, place = fs.FileSystem.from_uri(uri)
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_input_stream(place) as source, open(part, "wb") as out:
            while piece := source.read(1 << 22):
                out.write(piece)
        os.replace(part, path)
    return path
